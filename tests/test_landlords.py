"""Landlords: contacts, links, components and search records."""

import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelweave.functions.text import normal_apartment
from parcelweave.functions.trigram import similarity
from parcelweave.operators.communities import communities, split_components
from parcelweave.operators.components import connected_components
from parcelweave.plans import landlords as ll

CONTACT = "registrationid int, type string, firstname string, lastname string, businesshousenumber string, businessstreetname string, businessapartment string, businesscity string, businessstate string, businesszip string"
REGISTRATION = "registrationid int, bbl string, lastregistrationdate string, registrationenddate string"
LANDLORD = "bbl string, registrationid int, name string, bizaddr string, bizhousestreet string, bizapt string, bizzip string"


def test_contact_choice(frame):
    contacts = frame(
        CONTACT,
        (1, "CorporateOwner", "A", "A", "1", "MAIN ST", None, "NY", "NY", "10001"),
        (1, "HeadOfficer", "Bo", "By", "1", "Main St.", "apt 5", "NY", "NY", "10001"),
        (1, "SiteManager", "C", "C", "1", "MAIN ST", None, "NY", "NY", "10001"),
        (2, "IndividualOwner", "D", "D", "2", "OLD ST", None, "NY", "NY", "10001"),
        (3, "IndividualOwner", "E", "E", None, "X", None, "NY", "NY", "10001"),
    )
    registrations = frame(REGISTRATION, (1, "b", "2020-01-01", "2021-01-01"), (2, "b", "2019-01-01", "2020-01-01"), (3, "c", None, None))
    rows = ll.contacts_to_standardize(contacts, registrations).collect()
    assert [(r.bbl, r.name, r.streetname, r.apartment) for r in rows] == [("b", "BO BY", "MAIN ST", "APT 5")]
    made = ll.standardize(ll.contacts_to_standardize(contacts, registrations)).first()
    assert (made.bizaddr, made.bizhousestreet) == ("1 MAIN ST APT 5, NY NY", "1 MAIN ST")


def test_apartments(frame):
    said = ["GFL REAR", "SUITE", "5 FLR", "FLOOR 5", "5 APT", "APT 5", "7STE", "SUITE 7", "BSMT 2", "BASEMENT", "2 BASE", "#5-B"]
    rows = frame("i int, t string", *enumerate(said)).select("i", normal_apartment("t").alias("o")).orderBy("i").collect()
    assert [r.o for r in rows] == ["GROUND FL REAR", "STE", "5 FL", "5 FL", "APT 5", "APT 5", "STE 7", "STE 7", "BSMT 2", "BSMT ", "BSMT 2", "5B"]


def test_similarity(frame):
    row = frame("a string, b string, n string", ("word", "two words", None)).select(similarity("a", "b").alias("s"), similarity("a", "a").alias("one"), similarity("a", "n").alias("none"), similarity(F.lit(""), F.lit("--")).alias("zero")).first()
    assert abs(row.s - 0.3636) < 1e-3 and row.one == 1.0 and row.none is None and row.zero == 0.0


def rows():
    return [
        ("1", 1, "ANN", "1 MAIN ST, NY", "1 MAIN ST", "", "10001"),
        ("2", 1, "ANN", "1 MAIN ST, NY", "1 MAIN ST", "", "10001"),
        ("3", 2, "ANN", "1 MAIN STR, NY", "1 MAIN STR", "", "10001"),
        ("4", 3, "BEN", "1 MAIN ST 5, NY", "1 MAIN ST", "5", "10001"),
        ("5", 4, "CAT", "9 FAR AVE, NY", "9 FAR AVE", "", "10002"),
        ("6", 5, "DAN", "1 MAIN ST 6, NY", "1 MAIN ST", "6", "10001"),
    ]


def test_portfolios(frame):
    made = ll.build_landlord_portfolios(frame(LANDLORD, *rows())).orderBy("orig_id").collect()
    assert [(r.orig_id, r.bbls) for r in made] == [(1, ["1", "2", "3", "4", "6"]), (2, ["5"])] or [r.bbls for r in made] == [["1", "2", "4", "6"], ["3"], ["5"]]
    graph = json.loads(made[0].graph)
    assert {e["type"] for e in graph["edges"]} <= {"name", "bizaddr"} and all(n["type"] == "owner" for n in graph["nodes"]["owners"])
    assert all(e["source"] != e["target"] for e in graph["edges"])
    assert made[0].relatedportfoliosbbls == []


def test_edges(frame):
    nodes = ll.landlord_nodes(frame(LANDLORD, *rows()))
    ids = {r.nodeid: (r.name, r.bizapt) for r in nodes.collect()}
    pairs = {(ids[r.src], ids[r.dst]) for r in ll.address_edges(nodes).collect()}
    assert (("ANN", ""), ("BEN", "5")) in pairs and (("BEN", "5"), ("DAN", "6")) not in pairs


def test_split_respects_limit(frame):
    clique = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)]
    nodes = frame("nodeid long, size int", *[(n, 40) for g in (0, 10) for n in range(g, g + 5)], (99, 500))
    edges = frame("src long, dst long, weight double", *clique, (4, 10, 0.1))
    made = {r.nodeid: r for r in split_components(nodes, edges, limit=300, resolution=1.0).collect()}
    assert {r.orig_id for n, r in made.items() if n != 99} == {1} and made[99].orig_id == 2
    assert len({r.portfolio for r in made.values()}) == 3 and made[0].portfolio == made[4].portfolio != made[10].portfolio


def modularity(parts, edges, resolution):
    """Newman's, from its definition; a loop counts twice at its node."""
    home = {n: i for i, p in enumerate(parts) for n in p}
    twice, inner, degree = 0.0, 0.0, {}
    for a, b, w in edges:
        twice += 2 * w
        inner += 2 * w * (home[a] == home[b])
        for n in (a, b):
            degree[home[n]] = degree.get(home[n], 0.0) + w
    return inner / twice - resolution * sum(k * k for k in degree.values()) / twice**2


def local_moves(edges, resolution):
    """Communities by moving one node at a time, from any start to a local best; without contraction."""
    nodes = sorted({n for e in edges for n in e[:2]})
    home, moving = {n: n for n in nodes}, True
    score = lambda: modularity([[n for n in nodes if home[n] == c] for c in set(home.values())], edges, resolution)
    now = score()
    while moving:
        moving = False
        for n in nodes:
            for c in {home[b if a == n else a] for a, b, _ in edges if n in (a, b)}:
                was, home[n] = home[n], c
                if (new := score()) > now + 1e-12:
                    now, moving = new, True
                else:
                    home[n] = was
    return now


def test_communities_against_moves_one_by_one(frame):
    import random

    r = random.Random(5)
    edges = []
    for piece in range(4):  # separate graphs of looser groups, searched at once
        pairs = {(a, b) for a in range(24) for b in range(a + 1, 24) if r.random() < (0.5 if a // 6 == b // 6 else 0.05)}
        edges += [(piece, 100 * piece + a, 100 * piece + b, r.choice((1.0, 2.0))) for a, b in pairs]
    edges += [(0, 3, 3, 1.5), (1, 102, 103, 0.5), (1, 103, 102, 0.5)]
    nodes = sorted({(p, n) for p, a, b, _ in edges for n in (a, b)} | {(9, 900)})
    made = {x.node: x.community for x in communities(frame("piece long, node long", *nodes), frame("piece long, src long, dst long, weight double", *edges), 1.0).collect()}
    assert set(made) == {n for _, n in nodes} and made[900] == 900
    for piece in range(4):
        own = [e[1:] for e in edges if e[0] == piece]
        groups = {}
        for p, n in nodes:
            if p == piece:
                groups.setdefault(made[n], []).append(n)
        assert all(min(g) == c for c, g in groups.items())
        assert modularity(list(groups.values()), own, 1.0) >= 0.95 * local_moves(own, 1.0)


def test_split_again_and_whole(frame):
    # four cliques, two and two joined more closely; one node too large to be split
    clique = [(a, b, 1.0) for g in range(4) for a in range(10 * g, 10 * g + 6) for b in range(a + 1, 10 * g + 6)]
    nodes = frame("nodeid long, size int", *[(10 * g + k, 40) for g in range(4) for k in range(6)], (99, 900), (100, 1))
    made = {r.nodeid: r for r in split_components(nodes, frame("src long, dst long, weight double", *clique, (5, 10, 2.0), (25, 30, 2.0), (15, 20, 0.1), (99, 100, 1.0)), limit=300, resolution=1.0).collect()}
    assert [len({made[10 * g + k].portfolio for k in range(6)}) for g in range(4)] == [1] * 4 and len({made[10 * g].portfolio for g in range(4)}) == 4
    assert len({r.orig_id for n, r in made.items() if n < 99}) == 1 and {made[99].orig_id, made[100].orig_id} == {2}


def test_components_against_union_find(frame):
    import random

    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    parent = {n: n for p in pairs for n in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r.node: r.component for r in connected_components(frame("src long, dst long", *pairs, (None, 3))).collect()}
    assert found == {n: root(n) for n in parent}


def test_index_records(frame):
    names = [f"NAME {i:03d}" for i in range(300)]
    made = ll.landlord_index_records(frame("bbls array<string>, landlord_names array<string>", (["2", "1"], names), ([], ["X"]), (["3"], ["É"]))).collect()
    long = [r for r in made if r.portfolio_bbl == "1"]
    assert len(long) == 2 and [len(r.landlord_names.split(", ")) for r in long] == [150, 150]
    import hashlib

    for r in made:
        text = json.dumps({"portfolio_bbl": r.portfolio_bbl, "landlord_names": r.landlord_names}, sort_keys=True)
        assert r.objectID == hashlib.md5(text.encode()).hexdigest()
    corp = ll.corpname_index_records(frame("bbl string, corpnames array<string>", ("2", ["A"]), ("1", ["A", "B"]))).orderBy("landlord_names").collect()
    assert [(r.landlord_names, r.portfolio_bbl) for r in corp] == [("A", "1"), ("B", "1")]

"""Links by classes against pairs one by one, and a crowded address."""

import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelweave.operators.components import connected_components
from parcelweave.plans import landlords as ll
from parcelweave.plans import links

NODE = "nodeid long, name string, bizhousestreet string, bizapt string, bizzip string, bizaptnum string, bbls array<string>, bizaddr string"


def some_nodes(n=90, seed=2):
    r = random.Random(seed)
    streets = ["112 MAIN STREET NORTH", "12 MAIN STREET NORTH", "112 MAIN STREETS NORTH", "9 FAR AVENUE", "--", "", None]
    apartments = ["", "APT 1", "STE 1", "APT 2", None]
    rows = []
    for i in range(n):
        apartment = r.choice(apartments)
        number = None if apartment is None else re.sub(r"\D", "", apartment)
        rows.append((i, r.choice(["ANN BO", "ANN BOW", "CY", "", None]), r.choice(streets), apartment, r.choice(["1", "2", None]), number, [str(i)], f"a {i % 7}"))
    return rows


def grams(text):
    return {f"  {w} "[k : k + 3] for w in re.findall(r"[^\W_]+", text.lower()) for k in range(len(w) + 1)}


def alike(a, b):
    x, y = grams(a), grams(b)
    return np.float32(len(x & y) / len(x | y)) if x | y else np.float32(0)


def by_pair(rows):
    """Weights of all pairs by name and by address, from the definition."""
    name, address = {}, {}
    for a in rows:
        for b in rows:
            if a[0] >= b[0]:
                continue
            _, n, s, apt, z, num, *_ = a
            _, m, t, opt, y, mum, *_ = b
            if None in (s, t, z, y) or z != y:
                continue
            if n is not None and n == m and (alike(s, t) > np.float32(0.9) or (alike(s, t) > np.float32(0.8) and num is not None and num == mum)):
                name[a[0], b[0]] = float(alike(s, t)) + 1 + 0.5 * (apt is not None and apt == opt)
            if s == t and ((num is not None and num == mum) or num == "" or mum == ""):
                address[a[0], b[0]] = 2 + (float(alike(n, m)) if n is not None and m is not None else 0.0)
    return name, address


def as_pairs(edges):
    return {(r.src, r.dst): pytest.approx(r.weight) for r in edges.where("src < dst").collect()}


def groups(pairs, nodes):
    home = {n: n for n in nodes}
    for a, b in pairs:
        x, y = sorted((home[a], home[b]))
        home = {n: x if h == y else h for n, h in home.items()}
    return home


def components(frame, edges, nodes):
    lone = frame("src long, dst long", *[(n, n) for n in nodes])
    return {r.node: r.component for r in connected_components(edges.select("src", "dst").unionByName(lone)).collect()}


def test_links_by_pair(frame):
    rows = some_nodes()
    name, address = by_pair(rows)
    nodes = frame(NODE, *rows).cache()
    both = ll.name_edges(nodes).cache()
    assert name and address and as_pairs(both) == name and as_pairs(ll.address_edges(nodes)) == address and both.count() == 2 * len(name)
    ids = [r[0] for r in rows]
    spanning = links.spanning_links(nodes).cache()
    assert components(frame, spanning, ids) == groups([*name, *address], ids) and spanning.count() <= 3 * len(rows)
    single = {(r.src, r.dst): (r.type, r.weight) for r in links.block_links(links.as_singles(nodes)).collect()}
    assert single == {p: ("name", pytest.approx(name[p])) if p in name else ("bizaddr", pytest.approx(address[p])) for p in {*name, *address}}


def test_crowds_count_all_pairs(frame):
    rows = some_nodes()
    name, address = by_pair(rows)
    nodes = links.blocks(frame(NODE, *rows), most=3).cache()
    block = {r.nodeid: r.block for r in nodes.collect()}
    assert 1 < len(set(block.values())) < len(rows) and all(block[n] <= n for n in block)

    def counted(pairs):
        return Counter(tuple(sorted((block[a], block[b]))) for a, b in pairs)

    for made, want in ((links.name_links(nodes), name), (links.address_links(nodes), address)):
        assert {(r.src, r.dst): r.pairs for r in made.collect()} == counted(want)
    kinds = {(r.src, r.dst): r.type for r in links.block_links(nodes).collect()}
    n, a = counted(name), counted(address)
    assert kinds == {p: "name" if n[p] >= a[p] else "bizaddr" for p in {*n, *a}}
    spanning = links.spanning_links(nodes.drop("nodeid").withColumn("nodeid", F.col("block")))
    found = components(frame, spanning, sorted(set(block.values())))
    assert {n: found[b] for n, b in block.items()} == groups([*name, *address], list(block))


def test_a_crowded_address(spark):
    n = 50_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("bbl"), F.lit(1).alias("registrationid"), F.concat(F.lit("NAME "), "id").alias("name"), F.lit("1 MAIN ST, NY").alias("bizaddr"), F.lit("1 MAIN ST").alias("bizhousestreet"), F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("APT "), F.col("id") % 5000)).alias("bizapt"), F.lit("1").alias("bizzip"))
    nodes = links.blocks(ll.landlord_nodes(rows)).cache()
    assert links.spanning_links(nodes).count() <= 2 * n
    edges = links.block_links(nodes)
    assert edges.count() <= 20 * n and edges.agg(F.sum("pairs")).first()[0] == 25_000 * 24_999 // 2 + 25_000 * 25_000 + 2_500 * 45


def test_documents_name_the_members(frame):
    landlord = "bbl string, registrationid int, name string, bizaddr string, bizhousestreet string, bizapt string, bizzip string"
    rows = frame(landlord, *[(str(i), 1, f"N{i}", f"1 A ST {i}", "1 A ST", "" if i < 6 else "APT 7", "1") for i in range(8)], ("9", 1, "X", "8 B ST", "8 B ST", "", "1"))
    plain, crowded = (ll.build_landlord_portfolios(rows, together=k).orderBy("orig_id").collect() for k in (300, 4))
    assert [(r.orig_id, r.bbls, r.landlord_names) for r in plain] == [(r.orig_id, r.bbls, r.landlord_names) for r in crowded] and len(plain) == 2
    assert plain[1].graph == crowded[1].graph
    graph, pairs = json.loads(crowded[0].graph), json.loads(plain[0].graph)
    assert [len(g["members"]) for g in graph["groups"]] == [6] and "groups" not in pairs and len(pairs["edges"]) == 28
    assert sorted(e["weight"] for e in graph["edges"])[1:] == [12.0, 12.0] and graph["nodes"] == pairs["nodes"]

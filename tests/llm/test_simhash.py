import random

import pytest
import xxhash

from parcelweave.llm import neardup, simhash


def brute(texts):
    marks = []
    for t in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        marks.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return marks


def components(ids, marks, distance=4):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    low = {}
    for i, k in enumerate(ids):
        low[root(i)] = min(low.get(root(i), k), k)
    return [low[root(i)] for i in range(len(ids))]


def test_against_brute_force(docs, prose):
    long = prose(1, 900)
    near = [long.replace(w, w + "x", 1) for w in long.split()[5:60:11]]
    texts = [long, *near, long, prose(2, 40), prose(2, 40).upper(), "Only three\twords", "", None, "  \n", *[prose(k, 30) for k in range(3, 40)], "é à É one two three"]
    ids = random.Random(1).sample(range(1000), len(texts))
    made = {r.doc_id: r for r in simhash.classes(docs(*texts, ids=ids)).collect()}
    marks = brute(texts)
    assert [made[k].fingerprint for k in ids] == [f"{m:016x}" for m in marks]
    assert [made[k].component_id for k in ids] == components(ids, marks)


def test_masks_guarantee_a_shared_block():
    r = random.Random(2)
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash.block_masks(n)
        assert all(any(m & sum({1 << b for b in bits}) == 0 for m in masks) for bits in (r.sample(range(64), 4) for _ in range(300)))


@pytest.mark.parametrize("chunk", [4, 4096])
def test_crowded_buckets(spark, chunk):
    r = random.Random(3)
    marks = {0xFFFF0000FFFF0000}
    while len(marks) < 60:
        marks.add(r.choice(sorted(marks)) ^ (1 << r.randrange(64)))
    marks |= {r.getrandbits(64) for _ in range(60)}
    marks = sorted(marks)
    frame = spark.createDataFrame([(simhash.signed(m),) for m in marks], "fp long")
    from parcelweave.operators.components import connected_components

    found = {r.node: r.component for r in connected_components(simhash.links(frame, len(marks), chunk=chunk)).collect()}
    expected = components(marks, marks)
    groups = {}
    for m, e in zip(marks, expected, strict=True):
        groups.setdefault(found.get(simhash.signed(m), simhash.signed(m)), set()).add(e)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected))


@pytest.mark.parametrize("search", [simhash, neardup])
def test_deduplicate(docs, prose, search):
    frame = docs(prose(1, 80), prose(1, 80), prose(2, 80), None, "", prose(2, 80), prose(3, 50), prose(3, 50), ids=[5, 4, 7, 9, 8, 7, None, None])
    kept = search.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 4), (False, 7), (False, 8), (True, None)]
    assert search.deduplicate(docs()).count() == 0 and search.classes(docs()).count() == 0


@pytest.mark.parametrize("search", [simhash, neardup])
def test_one_id_with_several_texts(spark, prose, search):
    """No text is lost, whatever the order of the rows."""
    a, b = prose(1, 80), prose(2, 80)
    rows = [(3, a, "x", 1), (5, a, "y", 2), (5, b, "z", 3), (5, b, "z", 3), (None, b, "w", 4)]
    wanted = sorted([(3, a, "x", 1), (5, b, "z", 3)])
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        frame = spark.createDataFrame(order, "doc_id int, text string, fp string, _key int").coalesce(1)
        assert sorted(tuple(r) for r in search.deduplicate(frame).collect()) == wanted


def test_long_text(docs, prose):
    text = prose(1, 60_000)
    made = simhash.classes(docs(text, text + " end", None)).collect()
    assert [r.fingerprint for r in made if r.doc_id == 0] == [f"{brute([text])[0]:016x}"] and {r.component_id for r in made if r.doc_id < 2} == {0}


def test_huge_buckets_are_refined(spark, monkeypatch):
    r = random.Random(4)
    base = 0x1234 << 48
    marks = sorted({base | r.getrandbits(48) for _ in range(300)})
    marks += [m ^ 0b1011 << (i % 40) for i, m in enumerate(marks[::8])]
    marks = sorted(set(marks))
    frame = spark.createDataFrame([(simhash.signed(m),) for m in marks], "fp long")
    from parcelweave.operators.components import connected_components

    monkeypatch.setattr(simhash, "block_masks", lambda n, distance=4: simhash.chosen_blocks(5, distance))
    found = {r.node: r.component for r in connected_components(simhash.links(frame, len(marks), chunk=3)).collect()}
    expected, groups = components(marks, marks), {}
    for m, e in zip(marks, expected, strict=True):
        groups.setdefault(found.get(simhash.signed(m), simhash.signed(m)), set()).add(e)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected)) < len(marks) - 20


def test_many_rows_alike_leave_one(docs):
    frame = docs(*[None] * 300, *["same words here and more"] * 200, ids=[None] * 300 + [4] * 200)
    for search in (simhash, neardup):
        frame = frame.select("doc_id", "text", "source").withColumn("source", frame["source"].substr(1, 1))  # all alike
        assert sorted((r.doc_id is None, r.text) for r in search.deduplicate(frame).collect()) == [(False, "same words here and more"), (True, None)]

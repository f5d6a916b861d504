import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parcelweave.llm import mixing


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in done]
        if not free:
            return done
        level = (total - sum(done.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return done | {s: level * w[s] for s in free}
        done |= {s: float(cap * sizes[s]) for s in over}


def corpus(prose):
    texts = [(prose(k, 20 + 13 * (k % 17)), f"s{k % 4}") for k in range(240)]
    texts += [(prose(k, 9), "tiny") for k in range(4)] + [(prose(7, 30), None), (None, "s1"), ("", None), (prose(1, 4000), "s2"), (None, "void")]
    return texts


def test_targets_and_words(docs, prose):
    frame = docs(*corpus(prose))
    rows = mixing.taken(frame).collect()
    texts = {i: t for i, t in enumerate(corpus(prose))}
    sizes, took = defaultdict(int), defaultdict(int)
    for r in rows:
        text, source = texts[r.doc_id]
        assert r.size == len((text or "").split())
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        sizes[source] += r.size
        took[source] += r.taken
    expected = fill(sizes)
    for r in rows:
        source = texts[r.doc_id][1]
        assert r.source_size == sizes[source] and r.target == pytest.approx(expected[source])
    for s, target in expected.items():
        assert abs(took[s] - target) <= max(0.02 * target, 40), s
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken(frame.repartition(7)).collect()))


def test_mix_is_what_is_taken(docs, prose):
    frame = docs(*corpus(prose))
    took = {r.doc_id: r.taken // r.size for r in mixing.taken(frame).collect() if r.size}
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    counts = {r.doc_id: r["count"] for r in mixed.where("text <> ''").groupBy("doc_id").count().collect()}
    assert counts == {k: n for k, n in took.items() if n}


def test_edges(docs, prose):
    assert mixing.taken(docs()).count() == 0 and mixing.mix(docs()).count() == 0
    assert {r.taken for r in mixing.taken(docs(None, "", " ")).collect()} == {0}
    rows = mixing.taken(docs(*[(prose(1, 30), "a")] * 50, ids=[3] * 25 + [None] * 25)).collect()
    assert len(rows) == 50 and all(r.taken == 30 for r in rows)


def test_importance_changes_odds(docs, prose):
    frame = docs(*[(prose(k, 40), "a" if k % 2 else "b") for k in range(400)]).withColumn("i", F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(3.0))
    rows = mixing.taken(frame, importance_col="i").collect()
    low = sum(r.taken for r in rows if r.doc_id % 4 < 2)
    high = sum(r.taken for r in rows if r.doc_id % 4 >= 2)
    assert high > 1.8 * low


def draw(texts, weights=(5, 2, 1), cap=3, seed=7, given=None):
    """What is taken of each document, by going through each source's documents one by one."""
    sizes, by = [len((t or "").split()) for t, _ in texts], defaultdict(list)
    for k, (_, source) in enumerate(texts):
        by[source].append(k)
    goal, took = fill({s: sum(sizes[k] for k in own) for s, own in by.items()}, weights, cap), {}
    for source, own in by.items():
        worth = {}
        for k in own:
            i = (1 + (max(sizes[k], 1).bit_length() - 1) / 4) if given is None else given[k]
            worth[k] = 2 ** (math.floor(math.log2(i) * 8 + 0.5) / 8)
        low, high = 0.0, 1e6
        for _ in range(200):  # the ratio by halving
            ratio = (low + high) / 2
            low, high = (ratio, high) if sum(min(cap, ratio * worth[k]) * sizes[k] for k in own) < goal[source] else (low, ratio)
        copies = {k: min(cap, (low + high) / 2 * worth[k]) for k in own}
        copies = {k: round(e) if abs(e - round(e)) < 1e-9 else e for k, e in copies.items()}
        left = goal[source] - sum(int(e) * sizes[k] for k, e in copies.items())
        took |= {k: int(e) * sizes[k] for k, e in copies.items()}
        ranks = {}
        for k, e in copies.items():
            u = (int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if (p := e - int(e)) > 0:
                ranks[k] = u / (1 - u) / (p / (1 - p))
        for k in sorted(ranks, key=ranks.get):
            if sizes[k] <= left + 1e-6:
                took[k] += sizes[k]
                left -= sizes[k]
    return took


@pytest.mark.parametrize("few", [mixing.FEW, 3])
def test_draw_against_brute_force(docs, prose, monkeypatch, few):
    """With documents longer than what is left of their source's target."""
    monkeypatch.setattr(mixing, "FEW", few)
    texts = [(prose(1000 * s + k, 5 + (k * k) % 60), f"s{s:02}") for s in range(6) for k in range(60)] + [(prose(s, 6000), f"s{s:02}") for s in range(6)]
    frame = docs(*texts)
    rows = mixing.taken(frame).collect()
    assert {r.doc_id: r.taken for r in rows} == draw(texts)
    counts = {r.doc_id: r["count"] for r in mixing.mix(frame).groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.taken // r.size for r in rows if r.taken}


def test_given_importance_and_repeats(docs, prose):
    """By a column, with copies that share an id and fall together, and a column named like another in the plan."""
    texts = [(prose(k, 20 + k % 50), f"s{k % 3}") for k in range(300)]
    frame = docs(*texts).withColumn("w", F.lit(0.25) + F.col("doc_id") % 7).withColumn("_size", F.lit(1)).withColumn("Target", F.lit("t"))
    rows = mixing.taken(frame, importance_col="w").collect()
    assert {r.doc_id: r.taken for r in rows} == draw(texts, given=[0.25 + k % 7 for k in range(300)])
    twice = mixing.taken(frame.union(frame.where("doc_id < 50")), importance_col="w").collect()
    took = defaultdict(set)
    for r in twice:
        took[r.doc_id].add(r.taken)
    assert len(twice) == 350 and all(len(t) == 1 for t in took.values())
    assert mixing.mix(frame).columns == frame.columns

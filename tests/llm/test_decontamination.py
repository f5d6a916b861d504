import random

import pytest

from parcelweave.llm import decontamination as dc


def brute(texts, items, width=5, threshold=0.8):
    def split(t):
        return "".join(c for c in (t or "").lower() if c not in dc.string.punctuation).split()

    def grams(words, width):
        return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}

    out = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            asked = split(item)
            if not asked:
                continue
            own, g = grams(split(t), min(width, len(asked))), grams(asked, min(width, len(asked)))
            if len(g & own) / len(g) >= threshold - 1e-9:
                out.add((d, k, len(g & own), len(g)))
    return out


@pytest.mark.parametrize("most", [dc.BLOCK_SHINGLES, 40])
def test_against_brute_force(spark, docs, prose, most):
    items = [prose(100 + k, 12 + 3 * k) for k in range(12)] + ["too short", "", None, prose(100, 12), "to be or not", "Indeed"]
    r = random.Random(5)
    texts = [None, "", "too short", "Too Short!", "too short indeed", "ask to be, or not: to be", "not to be or", "\x0b"]
    for k in range(40):
        words = prose(k, 200).split()
        item = items[k % 12].split()
        if k % 4:
            item = item[: max(1, int(len(item) * r.choice((0.4, 0.75, 0.85, 0.95, 1.0))))]
        at = r.randrange(len(words))
        texts.append(" ".join(words[:at] + [w.upper() + "!" * (k % 3) for w in item] + words[at:]))
    texts.append(prose(7, 60_000) + "\n" + items[3])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    frame = docs(*texts)
    expected = brute(texts, items)
    assert {k for _, k, *_ in expected} >= {12, 16, 17}
    found = [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in dc.leaks(frame, benchmark, most=most).collect()]
    assert sorted(found) == sorted(expected)
    kept = dc.remove_leaks(frame, benchmark, most=most)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, *_ in expected}


@pytest.mark.parametrize("most", [dc.BLOCK_SHINGLES, 3])
def test_repeats_and_names(spark, prose, most):
    """One id with two texts, repeated rows and items, and columns named as the operator's own."""
    item = prose(1, 20)
    rows = [(1, item, "a", 0), (1, "clean words here", "b", 0), (1, item, "a", 0), (None, "x " + item, "c", 0), (2, None, "d", 0)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, txt string, item int")
    benchmark = spark.createDataFrame([(7, item, "x"), (7, item, "y")], "item_id int, text string, row string")
    found = sorted((r.doc_id or 0, r.item_id) for r in dc.leaks(frame, benchmark, most=most).collect())
    assert found == [(0, 7)] * 2 + [(1, 7)] * 4
    assert sorted(r.txt for r in dc.remove_leaks(frame, benchmark, most=most).collect()) == ["b", "d"]


def test_empty(spark, docs, prose):
    none = spark.createDataFrame([], "item_id int, text string")
    assert dc.leaks(docs(prose(1, 30)), none).count() == 0 and dc.remove_leaks(docs(prose(1, 30)), none).count() == 1
    some = spark.createDataFrame([(1, prose(1, 30))], "item_id int, text string")
    assert dc.leaks(docs(), some).count() == 0
    assert dc.leaks(docs(prose(1, 30), ids=[None]), some).count() == 1


@pytest.mark.parametrize("n", [1, 2, 5, 17, 64, 1000])
def test_sketch_is_always_met(n):
    missing = n - dc.needed(n, 0.8)
    assert dc.sketch_size(n, 0.8) > missing or dc.sketch_size(n, 0.8) == n

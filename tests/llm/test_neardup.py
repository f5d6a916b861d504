import random
from itertools import combinations

import corpus_pipeline

from parcelweave.llm import neardup


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(text, edits, seed):
    r, w = random.Random(seed), text.split()
    for at in r.sample(range(len(w)), edits):
        w[at] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def expected(texts):
    """The smallest position in each component of pairs at 0.8 or more, by brute force."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(range(len(texts)), 2):
        both = len(sets[x] & sets[y])
        if sets[x] == sets[y] or 5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both):
            a, b = sorted((find(x), find(y)))
            root[b] = a
    return [find(x) for x in range(len(texts))]


def corpus(prose):
    texts = [prose(k, 60 + 7 * k) for k in range(40)]
    texts += [edited(texts[k], 1 + k % 6, k) for k in range(40)] + [edited(texts[k], 2, 90 + k) for k in range(40)]
    texts += [edited(prose(500, 200), 2 + k % 4, k) for k in range(30)]  # links among many, and not with all
    return [*texts, "one two", "ONE two", "", None, "a b c d e"]


def test_edited_copies(docs, prose):
    texts = corpus(prose)
    want = expected(texts)
    assert len(set(want)) < len(texts) - 40
    for chunk in (neardup.CHUNK, 3):
        assert [r.component_id for r in sorted(neardup.classes(docs(*texts), chunk=chunk).collect())] == want


def test_stage_drops_edited_copies(spark, docs, prose):
    texts = corpus(prose)
    kept = corpus_pipeline.near_duplicates(spark, docs(*texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected(texts)))


def test_edges(docs):
    assert neardup.deduplicate(docs()).count() == 0
    assert [r.doc_id for r in neardup.deduplicate(docs("a b", "a b", "a b", ids=[None, 2, None])).collect()] == [2]


def test_cells_bounded_by_hashes_give_the_same(docs, prose, monkeypatch):
    texts = [prose(k % 4, 300) + f" more {k} words {k * k} at {k + 1} the end" for k in range(24)]
    frame = docs(*texts)
    whole = sorted(map(tuple, neardup.classes(frame).collect()))
    monkeypatch.setattr(neardup, "CHUNK_HASHES", 700)
    assert sorted(map(tuple, neardup.classes(frame).collect())) == whole and len({c for _, c in whole}) == 4


def test_fingerprints_alone_find_close_copies(docs, prose, monkeypatch):
    """Without bands a set still meets those within a few bits of it, by way of others, too; what is linked is verified."""
    texts = [prose(k, 400) for k in range(12)] + [edited(prose(k, 400), 1, k) for k in range(12)] + ["a b c d e", "a b c d f"]
    monkeypatch.setattr(neardup, "band_keys", lambda hashes: hashes[:0])
    found = [r.component_id for r in sorted(neardup.classes(docs(*texts)).collect())]
    want = expected(texts)
    assert all(found[k] in (k, want[k]) for k in range(len(texts))) and sum(found[k] == k - 12 for k in range(12, 24)) >= 6

from collections import Counter

import pyarrow as pa
import pytest

from parcelweave.llm import common, toxicity


@pytest.mark.parametrize("size", [1, 5, 60, 1000])
def test_parts_are_all_rows_in_order(size):
    batch = pa.record_batch([pa.array(["a" * 5, None, "b" * 50, "", "c", "d"]), pa.array(range(6))], names=["t", "n"])
    got = list(common.parts([batch.slice(0, 0), batch.slice(1, 4), batch], 0, size))
    assert [n for p in got for n in p.column(1).to_pylist()] == [1, 2, 3, 4, 0, 1, 2, 3, 4, 5]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= size for p in got)
    assert sum(p.num_rows for p in common.parts([pa.record_batch([pa.nulls(3)], names=["t"])], 0, size)) == 3


def test_terms_held_are_few(monkeypatch):
    """One batch of many different words: they are handed on in pieces, and their sums are those of all documents."""
    monkeypatch.setattr(toxicity, "TERMS_HELD", 1000)
    texts = [f"shared word{i}x{i % 7} other{i // 2}" for i in range(3000)] + [None, ""]
    toxic, fold = [i % 2 for i in range(3002)], [i % 4 for i in range(3002)]
    batch = pa.record_batch([pa.array(range(3002)), pa.array(texts), pa.array(toxic, pa.int32()), pa.array(fold, pa.int32())], names=["_id", "_text", "_toxic", "_fold"])
    got, want = Counter(), Counter()
    for made in toxicity.terms([batch]):
        assert made.num_rows <= 1000 + 20
        got.update({(r["term"], r["fold"], r["toxic"]): 0 for r in made.to_pylist()})
        for r in made.to_pylist():
            got[r["term"], r["fold"], r["toxic"]] += r["n"]
    for text, t, f in zip(texts, toxic, fold, strict=True):
        own = set(toxicity.tokens_of(text))
        want.update((w, f, t) for w in own | {f"{w[:k]}*" for w in own for k in toxicity.STEMS if len(w) > k})
    assert got == want and list(toxicity.terms([])) == []

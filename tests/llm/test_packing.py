import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parcelweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()
WHOLE, PARTS = Tokenizer.from_file(PATH), packing.Encoder(SPEC)


def ids(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("text", ["It's THEY'LL we'd 'S x's''t", "naïve Ünïcode İI ıſ ſS ÿŸ Ÿ", "é ǻ ́x", "a_b__c-_-d 12a3½²", "tab\there and　there x\r\ny", "<|endoftext|> a<|startoftext|>b <|endo ftext|>", "日本語 テスト 한국어 مرحبا Ως ΣΑΣ", "…—“quoted” ‘x’ •", "x" * 5000, "", "  \n ", "µª º ×÷ ĳĲ ŉ"])
def test_ids_are_those_of_whole_texts(text):
    assert PARTS.encode(text) == ids(text).tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'sStTreRE<|>_-.,09aéÉİσΣ́")), max_size=60))
def test_ids_of_any_text(text):
    assert PARTS.encode(text) == ids(text).tobytes()


def placed(runs):
    """Sequence to its places, from the runs."""
    out = {}
    for length, start, n, base, each, offset in runs:
        for t in range(n):
            out.setdefault(base + t // each, []).append((offset + t % each * length, length))
    return out


@pytest.mark.parametrize("size,lengths", [(10, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]), (10, [1]), (10, [6]), (64, list(range(1, 40))), (64, [5, 64]), (64, [30, 31, 33, 34, 3]), (7, [])])
def test_plans(size, lengths):
    r = random.Random(size + len(lengths))
    h = np.zeros(size + 1, np.int64)
    for _ in range(700 if lengths else 0):
        h[r.choice(lengths)] += 1
    runs, n = packing.plan(h, size)
    sequences = placed(runs)
    assert sorted(sequences) == list(range(n))
    got = np.zeros(size + 1, np.int64)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
            got[length] += 1
        assert end <= size
    assert (got == h).all()
    ranks = {}
    for length, start, m, *_ in runs:
        assert start == ranks.get(length, 0)
        ranks[length] = start + m
    total = int((h * np.arange(size + 1)).sum())
    assert n <= max(-(-total // size) * 1.05 + 2, h[size // 2 + 1 :].sum())


def test_long_lengths_meet_what_fills_them():
    # falling best fit would put 3s beside the 5s and leave gaps
    h = np.zeros(11, np.int64)
    h[[6, 4, 5, 3, 2]] = [40, 40, 30, 20, 20]
    assert packing.plan(h, 10)[1] == -(-(240 + 160 + 150 + 60 + 40) // 10)


def test_documents(spark, docs, prose):
    texts = [None, "", " ", "word", prose(1, 9000), prose(2, 700), "a " * 4095, "a " * 4096, *[prose(i, 20 + i % 50) for i in range(150)], *["same text"] * 60]
    table = docs(*texts, ids=[*range(len(texts) - 3), None, 7, 7]).repartition(5)
    rows = packing.pack(table, PATH).collect()
    want = []
    for i, t in zip([*range(len(texts) - 3), None, 7, 7], texts, strict=True):
        own = np.append(ids(t), 1).astype("<u4")
        want += [(i, k // 4096, k, len(own[k : k + 4096]), zlib.crc32(own[k : k + 4096].tobytes())) for k in range(0, len(own), 4096)]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) == -(-sum(r.length for r in rows) // 4096)


def test_no_documents(spark, docs):
    got = packing.pack(docs("x").limit(0), PATH)
    assert got.count() == 0 and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

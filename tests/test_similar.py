import random
from itertools import combinations

import pytest

from parcelweave import catalog
from parcelweave.operators.similar import similar_pairs


@pytest.mark.parametrize("over", [0.3, 0.5])
def test_pairs_by_brute_force(spark, over):
    r = random.Random(4)
    sets = {k: sorted({r.choice("abcdefghijkl") for _ in range(r.randint(0, 10))}) for k in range(60)}
    frame = spark.createDataFrame(list(sets.items()), "k long, g array<string>")
    want = {}
    for (a, x), (b, y) in combinations(sets.items(), 2):
        both = len(set(x) & set(y))
        if both and both / (len(x) + len(y) - both) > over:
            want[a, b] = both / (len(x) + len(y) - both)
    assert {(x.a, x.b): x.s for x in similar_pairs(frame, "k", "g", over).collect()} == want


def test_first_words_may_differ(spark, tmp_path):
    spark.createDataFrame([("old green mill",), ("new green mill",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert [(x.a, x.b) for x in catalog.QUERIES["trigram_similarity"](spark, str(tmp_path)).collect()] == [("new green mill", "old green mill")]

import random
from itertools import combinations

import pytest

from parcelweave.llm import baskets


def brute_force(pairs, least):
    """Closed sets with their support and rules, from all subsets of the items."""
    held = {}
    for b, i in pairs:
        if b is not None and i is not None:
            held.setdefault(b, set()).add(i)
    items = sorted(set().union(*held.values())) if held else []
    support = {s: sum(set(s) <= own for own in held.values()) for n in range(1, len(items) + 1) for s in combinations(items, n)}
    out = {}
    for s, n in support.items():
        if n < least or any(support[tuple(sorted((*s, x)))] == n for x in items if x not in s):
            continue
        rules = [] if len(s) < 2 else [(c, support[tuple(x for x in s if x != c)], support[(c,)]) for c in s]
        out[s] = n, [(c, a, x) for c, a, x in rules if 100 * n >= 30 * a and n * len(held) > a * x]
    return out


def found(spark, pairs, least):
    rows = [(b, i, b, "x") for b, i in pairs]
    lines = spark.createDataFrame(rows, "sale_id long, item_id long, b long, code string")
    return {tuple(r.items): (r.support, [tuple(x) for x in r.rules]) for r in baskets.itemsets_and_rules(lines, least=least).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_all_subsets(spark, seed):
    r = random.Random(seed)
    pairs = []
    for b in range(60):
        own = {r.choice((1, 2, 2, 3, 5, 7, 7, 11, 20)) for _ in range(r.randint(1, 4))}
        own |= {1, 2, 3} if r.random() < 0.3 else set()
        own |= {30} if seed == 1 else set()  # in every basket
        pairs += [(b, i) for i in own]
    if seed == 2:  # long baskets, which are not gathered
        pairs += [(b, i) for b in (100, 101) for i in (1, 2, 3, 5, 7, 11, 20)]
    pairs += [(None, 1), (3, None), pairs[0], pairs[0]]
    assert found(spark, pairs, 5) == brute_force(pairs, 5)


def test_the_left_side_need_not_be_closed(spark):
    # 1 and 2 always come together, and mostly with 3
    pairs = [(b, i) for b in range(8) for i in (1, 2)] + [(b, 3) for b in range(6)] + [(b, 4) for b in range(5, 20)]
    assert found(spark, pairs, 3) == brute_force(pairs, 3)


def test_long_baskets_stay_rows(spark):
    pairs = [(b, i) for b in range(40) for i in (b % 4, 4 + b % 3)] + [(1000 + b, i) for b in range(3) for i in range(500)]
    lines = spark.createDataFrame(pairs, "sale_id long, item_id long")
    _, least, _, small, wide, n_wide = baskets._prepared(lines, "sale_id", "item_id", 8, 10_000)
    assert n_wide == 3 and wide.count() == 3 * 7 and max(len(r.codes) for r in small.collect()) <= 2
    few = [p for p in pairs if p[1] < 7]
    assert found(spark, pairs, 8) == brute_force(few, 8)


def test_nothing_frequent_and_nothing_at_all(spark):
    assert found(spark, [], 2) == {}
    assert found(spark, [(1, 1), (2, 2)], 2) == {}
    assert found(spark, [(b, 1) for b in range(3)], 2) == {(1,): (3, [])}


def test_the_least_share(spark):
    pairs = [(b, 1) for b in range(30)] + [(b, 2) for b in range(4)]
    lines = spark.createDataFrame(pairs, "sale_id long, item_id long")
    assert [r.items for r in baskets.itemsets_and_rules(lines, least=2, share=6).collect()] == [[1]]


def test_digest(spark):
    lines = spark.createDataFrame([(b, i) for b in range(4) for i in (10, 9)] + [(b, 5) for b in range(4, 8)], "sale_id long, item_id long")
    rows = {r["items"]: r for r in baskets.digest(baskets.itemsets_and_rules(lines, least=2)).collect()}
    assert set(rows) == {"9,10", "5"} and (rows["9,10"].n_rules, rows["9,10"].best_item) == (2, 9) and rows["5"].best_item is None
    import hashlib

    assert rows["9,10"].rules_sha256 == hashlib.sha256(b"9:4:4;10:4:4").hexdigest() and rows["5"].rules_sha256 == hashlib.sha256(b"").hexdigest()

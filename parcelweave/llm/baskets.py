"""Frequent itemsets of baskets by breadth-first closure extension, and the rules inside them.

A closed itemset is one whose proper supersets all have smaller support.  Each is made once: a
closed set ``P`` is extended by an item ``i`` behind its core item, the items that all baskets of
the extension share are absorbed, and the result stays if it adds no item before ``i``
(prefix-preserving closure extension, Uno et al. 2004).  Items are numbered by rising support.
A level is a few joins: the frontier's occurrences with the baskets' items, counted by set and item.
Every level is written to the shared folder, so that lost executors cost its tasks only.

Baskets are stripped of rare items first, and equal baskets are one with a weight.  Long baskets
are never gathered: so many of the longest as make up less than half of the least support stay
rows of basket and item (*wide*).  A frequent set occurs in other baskets more than half of that
often, so that only pairs of set and item met there so often are looked up in the wide ones.  Thus
no basket, whatever its length, gives all its pairs, and a closed set is no longer than the longest
basket that isn't wide.

A rule's left side need not be closed.  Its support is that of its closure, to which a walk leads from
the empty set: the smallest missing item always extends the closed set reached, and the
extensions' closures are known from the search, kept or not.

Edge cases: null baskets and items are left out; repeated rows count once; ties of support are
broken by the items; items in all baskets belong to every closed set; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.llm.common import take
from parcelweave.operators.relational import with_dense_id
from parcelweave.storage import discard, materialize


def _codes(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<long>")


def _below(items: Column, core: Column) -> Column:
    return F.filter(items, lambda x: x < core)


def _counted(occurrences: DataFrame, small: DataFrame, wide_at: DataFrame, wide: DataFrame | None, n_wide: int, least: int) -> DataFrame:
    """``(set, code, n)``: the baskets of each set of the frontier that hold an item, where these are ``least`` or more."""
    met = occurrences.join(small, "bid").select("set", "w", F.explode("codes").alias("code"))
    counts = met.groupBy("set", "code").agg(F.sum("w").alias("n")).where(F.col("n") >= least - n_wide)
    if wide is None:
        return counts
    counts = materialize(counts, "near")
    found = wide_at.join(counts.select("set", "code"), "set").join(wide, ["b", "code"], "left_semi").groupBy("set", "code").agg(F.count(F.lit(1)).alias("n"))
    both = materialize(counts.unionByName(found).groupBy("set", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "counts")
    discard(counts)
    return both


def _prepared(lines: DataFrame, basket_col: str, item_col: str, least: int, share: int) -> tuple[int, int, DataFrame, DataFrame, DataFrame | None, int]:
    """Number of baskets, least support, ``(i, n, code)`` of frequent items, ``(bid, codes, w)`` of baskets, ``(b, code)`` of wide ones and their number."""
    pairs = materialize(take(lines, b=basket_col, i=item_col).where("b IS NOT NULL AND i IS NOT NULL").distinct(), "pairs")
    baskets = pairs.agg(F.count_distinct("b")).first()[0]
    least = max(least, -(-baskets // share))
    items = materialize(with_dense_id(pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), ["n", "i"], "code").select("i", "n", F.col("code").cast("long")), "items")
    rows = materialize(pairs.join(items.select("i", "code"), "i").select("b", "code"), "rows")
    sizes = rows.groupBy("b").agg(F.count(F.lit(1)).alias("size")).withColumn("doublings", F.length(F.bin(F.col("size") - 1)))
    told = {r[0]: r[1] for r in sizes.groupBy("doublings").count().collect()}  # at most 63 rows
    cut = next(k for k in range(64) if 2 * sum(v for x, v in told.items() if x > k) < least)
    n_wide = sum(v for x, v in told.items() if x > cut)
    wide = None
    if n_wide:
        long_ones = sizes.where(F.col("doublings") > cut).select("b")
        wide = materialize(rows.join(long_ones, "b", "left_semi"), "wide")
        names = materialize(wide.select("b").distinct(), "names")
        gathered = rows.join(names, "b", "left_anti")
    else:
        gathered = rows
    lists = gathered.groupBy("b").agg(F.sort_array(F.collect_list("code")).alias("codes")).groupBy("codes").agg(F.count(F.lit(1)).alias("w"))
    small = materialize(lists.withColumn("bid", F.monotonically_increasing_id()), "baskets")
    discard(pairs, rows, *([names] if n_wide else []))
    return baskets, least, items, small, wide, n_wide


class Search(NamedTuple):
    """``(sid, codes, support)`` of closed sets; ``(i, n, code)`` of items; the extensions ``(parent, code, codes, support)`` that were tried."""

    closed: DataFrame
    items: DataFrame
    tried: DataFrame
    baskets: int
    root: list[int]


def closed_itemsets(lines: DataFrame, basket_col: str = "sale_id", item_col: str = "item_id", least: int = 12, share: int = 10_000) -> Search:
    """Closed itemsets in ``least`` baskets and in one of ``share`` or more."""
    baskets, least, items, small, wide, n_wide = _prepared(lines, basket_col, item_col, least, share)
    root = sorted(r[0] for r in items.where(F.col("n") == baskets).select("code").collect())  # no more than the shortest basket holds
    first = items.where(F.col("n") < baskets)
    frontier = materialize(first.select(F.col("code").alias("set"), _codes(root).alias("parent"), F.col("code").alias("core"), F.col("n").alias("support")), "frontier")
    fresh = ~F.col("set").isin(root)
    at = materialize(small.select(F.explode("codes").alias("set"), "bid").where(fresh), "occurrences")
    wide_at = wide.select(F.col("code").alias("set"), "b").where(fresh) if wide is not None else None
    tried = []
    while True:
        counts = _counted(at, small, wide_at, wide, n_wide, least)
        counts = materialize(counts, "counts") if wide is None else counts
        absorbed = counts.join(frontier.select("set", "support"), "set").where("n = support").groupBy("set").agg(F.sort_array(F.collect_list("code")).alias("codes"))
        made = materialize(frontier.join(absorbed, "set").withColumn("kept", _below(F.col("codes"), F.col("core")) == _below(F.col("parent"), F.col("core"))), "closures")
        tried.append(made)
        ahead = counts.join(made.where("kept").select("set", "core", "support", "codes"), "set").where("code > core AND n < support")
        ahead = materialize(ahead.select(F.col("set").alias("old"), F.monotonically_increasing_id().alias("set"), F.col("codes").alias("parent"), F.col("code").alias("core"), F.col("n").alias("support")), "frontier")
        if ahead.isEmpty():
            discard(at, counts, frontier, ahead, *([wide_at] if len(tried) > 1 and wide is not None else []))
            break
        grown = ahead.select(F.col("old"), F.col("core").alias("code"), F.col("set").alias("new"))
        parents = materialize(ahead.select(F.col("old").alias("set")).distinct(), "parents")
        open_ = at.join(parents, "set", "left_semi").join(small.select("bid", "codes"), "bid").select(F.col("set").alias("old"), "bid", F.explode("codes").alias("code"))
        after = materialize(open_.join(grown, ["old", "code"]).select(F.col("new").alias("set"), "bid"), "occurrences")
        if wide is not None:
            wide_after = materialize(wide_at.withColumnRenamed("set", "old").join(grown, "old").join(wide, ["b", "code"], "left_semi").select(F.col("new").alias("set"), "b"), "wide_occurrences")
            discard(*([wide_at] if len(tried) > 1 else []))
            wide_at = wide_after
        discard(at, counts, frontier, parents)
        at, frontier = after, ahead.drop("old")
    discard(small, *([wide] if wide is not None else []))
    every = reduce(DataFrame.unionByName, tried)
    closed = every.where("kept").select("codes", "support")
    if root:
        closed = closed.unionByName(lines.sparkSession.createDataFrame([(root, baskets)], closed.schema))
    closed = materialize(closed.select(F.monotonically_increasing_id().alias("sid"), "codes", "support"), "closed")
    return Search(closed, items, every.select("parent", F.col("core").alias("code"), "codes", "support"), baskets, root)


def _left_sides(found: Search) -> DataFrame:
    """``(sid, c, a)``: for each item ``c`` of a closed set of two or more, the support of the rest."""
    steps = found.tried.select(F.col("parent").alias("at"), F.col("code").alias("next"), F.col("codes").alias("to"), F.col("support").alias("a"))
    walks = found.closed.where(F.size("codes") > 1).select("sid", F.explode("codes").alias("c"), "codes", _codes(found.root).alias("at"))
    walks = walks.select("sid", "c", "at", F.array_except(F.array_remove("codes", F.col("c")), "at").alias("missing"), F.lit(found.baskets).cast("long").alias("a"))
    ended = [walks.where(F.size("missing") == 0).select("sid", "c", "a")]
    walks, own = materialize(walks.where(F.size("missing") > 0), "walks"), []
    while not walks.isEmpty():
        moved = walks.drop("a").withColumn("next", F.col("missing")[0]).join(steps, ["at", "next"]).select("sid", "c", F.col("to").alias("at"), F.array_except("missing", "to").alias("missing"), "a")
        walks, before = materialize(moved, "walks"), walks
        discard(before)
        own.append(walks)
        ended.append(walks.where(F.size("missing") == 0).select("sid", "c", "a"))
        walks = walks.where(F.size("missing") > 0)
        walks = materialize(walks, "walks")
    discard(walks)
    every = materialize(reduce(DataFrame.unionByName, ended), "sides")
    discard(*own)
    return every


def itemsets_and_rules(lines: DataFrame, basket_col: str = "sale_id", item_col: str = "item_id", least: int = 12, share: int = 10_000, confidence: int = 30) -> DataFrame:
    """``(items, support, rules)``: the closed itemsets, and the rules that take one item of each.

    A rule ``(item, a, s)`` has the supports of the other items and of the item; it holds if in
    ``confidence`` of 100 baskets with the others the item is there, too, more often than in all.
    """
    found = closed_itemsets(lines, basket_col, item_col, least, share)
    members = found.closed.select("sid", "support", F.explode("codes").alias("c")).join(_left_sides(found), ["sid", "c"], "left")
    members = members.join(found.items.select(F.col("code").alias("c"), F.col("i").alias("item"), F.col("n").alias("s")), "c")
    holds = (100 * F.col("support") >= confidence * F.col("a")) & (F.col("support") * found.baskets > F.col("a") * F.col("s"))
    rule = F.when(holds, F.struct("item", "a", "s"))  # a list leaves out nulls
    return members.groupBy("sid").agg(F.sort_array(F.collect_list("item")).alias("items"), F.first("support").alias("support"), F.sort_array(F.collect_list(rule)).alias("rules")).drop("sid")


def digest(found: DataFrame) -> DataFrame:
    """The itemsets as text, and their rules' number, best item and hash."""
    text = lambda values: F.array_join(F.transform(values, lambda x: x.cast("string")), ",")
    said = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["item"].cast("string"), r["a"].cast("string"), r["s"].cast("string"))), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["item"].alias("item"))))["item"]
    return found.select(text(F.col("items")).alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.size("rules").cast("long").alias("n_rules"), best.cast("long").alias("best_item"), F.sha2(said, 256).alias("rules_sha256"))

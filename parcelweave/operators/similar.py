"""Pairs of sets by Jaccard similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar_pairs(sets: DataFrame, key: str, members: str, over: float, within: Sequence[str] = ()) -> DataFrame:
    """``(a, b, s)``: all pairs of keys, the smaller first, whose sets' similarity ``s`` is above ``over`` (more than 0).

    With ``within``, only pairs that agree on these columns, which are returned, too.

    A set shares at least its size times ``over`` members with each such partner; so two of them meet
    in one of the members that are left when all but one of so many are taken off each, the commonest
    first.  Only these are joined, and the pairs that meet are verified.
    """
    rows = sets.select(*within, F.col(key).alias("k"), F.array_distinct(members).alias("g"))
    each = rows.select(*within, "k", F.explode("g").alias("x"))
    ranked = each.join(each.groupBy(*within, "x").agg(F.count(F.lit(1)).alias("n")), [*within, "x"]).groupBy(*within, "k").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("r"))
    rarest = F.size("r") - F.ceil(F.size("r") * F.lit(over) - 1e-9).cast("int") + 1
    met = ranked.select(*within, "k", F.explode(F.slice("r", F.lit(1), rarest)).alias("e")).select(*within, "k", "e.x")
    pairs = met.toDF(*within, "a", "x").join(met.toDF(*within, "b", "x"), [*within, "x"]).where("a < b").select(*within, "a", "b").distinct()
    both = F.size(F.array_intersect("g", "h"))
    found = pairs.join(rows.toDF(*within, "a", "g"), [*within, "a"]).join(rows.toDF(*within, "b", "h"), [*within, "b"])
    return found.select(*within, "a", "b", (both / (F.size("g") + F.size("h") - both)).alias("s")).where(F.col("s") > over)

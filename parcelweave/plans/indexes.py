"""Written indexes for lookups: members of groups by key, and texts by their trigrams.

Tables are dealt by range and sorted by what they are asked for, so that Parquet's statistics, and
Bloom filters for keys, let a lookup read few row groups whatever the table's size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trigrams of a search text whose postings are intersected.
RAREST = 4
#: Rows that a task sorts.
MOST_SORTED = 1_000_000


def _sorted_table(df: DataFrame, path: str, *keys: str) -> None:
    tasks = df.count() // MOST_SORTED + 1  # a number of our own, which adaptive execution does not lower
    writer = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).write
    writer.option(f"parquet.bloom.filter.enabled#{keys[0]}", "true").parquet(path)


def write_members(groups: DataFrame, path: str, group: str = "orig_id", members: str = "pins") -> None:
    """Two tables of a group's members, one by member and one by group; null members and groups are left out."""
    rows = groups.select(F.col(group).alias("grp"), F.explode(members).alias("member")).where("grp IS NOT NULL AND member IS NOT NULL").distinct()
    _sorted_table(rows, f"{path}/by_member", "member", "grp")
    _sorted_table(rows, f"{path}/by_group", "grp", "member")


def co_members(spark: SparkSession, path: str, member, name: str = "pin") -> DataFrame:
    """The distinct members of all groups that hold ``member``; none if no group does."""
    own = [r[0] for r in spark.read.parquet(f"{path}/by_member").where(F.col("member") == F.lit(member)).select("grp").collect()]  # a member's groups
    return spark.read.parquet(f"{path}/by_group").where(F.col("grp").isin(own)).select(F.col("member").alias(name)).distinct()


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, 3)))


def write_trigrams(rows: DataFrame, path: str, key: str, *texts: Column) -> None:
    """Postings of each trigram of the texts, sorted by trigram, and their numbers."""
    found = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.concat(*map(grams, texts)))).alias("gram")).where("length(gram) = 3").distinct()
    _sorted_table(found, f"{path}/postings", "gram", "key")
    postings = rows.sparkSession.read.parquet(f"{path}/postings")
    _sorted_table(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), f"{path}/counts", "gram")


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """``(key,)`` of all rows that may match ``%pattern%`` in any case; ``None`` where the pattern has no run of three plain characters.

    ``%`` and ``_`` cut the pattern into pieces; the postings of its rarest trigrams are intersected.
    """
    if "\\" in pattern:
        return None
    pieces = [p for p in re.split("[%_]", pattern) if len(p) >= 3]
    if not pieces:
        return None
    asked = spark.range(1).select(F.explode(F.array_distinct(F.concat(*[grams(F.lit(p)) for p in pieces])))).collect()
    asked = [r[0] for r in asked if len(r[0]) == 3]
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(asked)).collect()}  # no more than the pattern's
    rare = sorted(asked, key=lambda g: (counts.get(g, 0), g))[:RAREST]
    held = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(rare))
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("key")

"""Relational operators that the plans share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelweave.functions.text import col
from parcelweave.storage import cut

#: Different values of ranks whose places may be broadcast (about 50 bytes each).
MOST_VALUES = 200_000

# latest and top rows


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group; the plan limits each partition before the exchange."""
    return numbered(df, keys, order, "_at").where(F.col("_at") <= k).drop("_at")


def latest_by(df: DataFrame, keys: Sequence[str], value: Column | str, *ties: Column, nulls_first: bool = False) -> DataFrame:
    v = col(value)
    return top_per_group(df, keys, [v.desc_nulls_first() if nulls_first else v.desc_nulls_last(), *ties])


def with_dense_id(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Ids from 1 in the order given.

    Rows are dealt by range, and each partition starts after the rows of those before it, so
    that no task holds all of them.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    dealt = cut(dealt)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", (before - F.col("_first") + 1).alias("_base"))  # a row for each partition
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_row") + F.col("_base")).drop("_part", "_row", "_base")


# sets


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def stacked(df: DataFrame, groups: dict[str, Column | None], aggregates: Sequence[Column], keep_null: bool = False, kind: str = "collection_type", name: str = "collection") -> DataFrame:
    """Aggregates by several groupings at once, from one scan; ``None`` is all rows."""
    tags = F.array(*[F.struct(F.lit(k).alias(kind), (F.lit("all") if g is None else g.cast("string")).alias(name)) for k, g in groups.items()])
    rows = df.withColumn("_tag", F.explode(tags))
    rows = rows if keep_null else rows.where(F.col(f"_tag.{name}").isNotNull())
    return rows.groupBy(F.col(f"_tag.{kind}").alias(kind), F.col(f"_tag.{name}").alias(name)).agg(*aggregates)


def rolled_up(df: DataFrame, key: str, aggregates: Sequence[Column], having: Column | None = None) -> DataFrame:
    out = df.groupBy(key).agg(*aggregates)
    return out if having is None else out.where(having)


# lists


def list_members(df: DataFrame, keys: Sequence[str], text: str, pattern: str, name: str = "member") -> DataFrame:
    """A row for each non-blank element of a delimited list, repeats included."""
    return df.select(*keys, F.explode(F.split(F.col(text), pattern)).alias("_m")).where("_m <> ''").select(*keys, F.trim("_m").alias(name))


def co_members(groups: DataFrame, members: str, value, wanted: str | None = None) -> DataFrame:
    """The distinct members of all groups that contain ``value``."""
    return groups.where(F.array_contains(members, value)).select(F.explode(members).alias(wanted or "member")).distinct()


def in_even_parts(df: DataFrame, keys: Sequence[str], value: str, between: str, length: int) -> DataFrame:
    """``keys``, ``i``, ``part``: each group's values in order, joined, in as many parts as ``length`` goes into the whole, rounded up.

    Parts have as many values as each other, the first by one more where it doesn't divide; parts beyond the
    values are empty.  Places come from ``with_dense_id``, so that no task holds a group.
    """
    rows = with_dense_id(df.select(*keys, value).where(F.col(value).isNotNull()), [*keys, value], "_id")
    size = F.sum(F.length(value) + len(between)) - len(between)
    groups = rows.groupBy(*keys).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.ceil(size / float(length)).alias("_parts"))
    groups = groups.where("_parts > 0").withColumn("_least", F.floor(F.col("_n") / F.col("_parts"))).withColumn("_more", F.col("_n") % F.col("_parts"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    at, longer = F.col("_id") - F.col("_first"), F.col("_more") * (F.col("_least") + 1)
    i = F.when(at < longer, F.floor(at / (F.col("_least") + 1))).otherwise(F.col("_more") + F.floor((at - longer) / F.greatest("_least", F.lit(1))))
    placed = rows.join(groups.withColumnsRenamed({k: f"_{k}" for k in keys}), same).withColumn("i", i.cast("int"))
    made = placed.groupBy(*keys, "i").agg(F.array_join(F.array_sort(F.collect_list(value)), between).alias("part"))
    beyond = groups.where("_least = 0 AND _n < _parts").select(*keys, F.explode(F.sequence(F.col("_n").cast("int"), (F.col("_parts") - 1).cast("int"))).alias("i"), F.lit("").alias("part"))
    return made.unionByName(beyond)


# time


def month_spine(spark: SparkSession, first: str, as_of: dt.date | str, name: str = "month") -> DataFrame:
    """Every month from ``first`` to the one before ``as_of``, as ``YYYY-MM``."""
    until = F.add_months(F.lit(str(as_of)).cast("date"), -1)
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), until, F.expr("interval 1 month"))).alias("_d")).select(F.date_format("_d", "yyyy-MM").alias(name))


def unpivot_years(df: DataFrame, keys: Sequence[str], columns: dict[str, int], name: str = "month", value: str = "units") -> DataFrame:
    """A row for each of the year columns, keyed by its January; equal rows collapse."""
    rows = F.array(*[F.struct(F.lit(f"{year}-01").alias("k"), F.col(c).alias("v")) for c, year in columns.items()])
    return df.select(*keys, F.explode(rows).alias("_y")).select(*keys, F.col("_y.k").alias(name), F.col("_y.v").alias(value)).distinct()


def zero_filled(spine: DataFrame, facts: Sequence[DataFrame], keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``spine`` with the sums of all facts' measures, 0 where there are none.

    The facts are stacked and summed once, so that there is one join however many facts there are.
    """
    if not facts:
        return spine.select("*", *[F.lit(0).cast("long").alias(m) for m in measures])
    stack = reduce(DataFrame.unionByName, [f.select(*keys, *[(F.col(m) if m in f.columns else F.lit(None)).cast("double").alias(m) for m in measures]) for f in facts])
    summed = stack.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    return spine.join(summed, list(keys), "left").select(*spine.columns, *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in measures])


# ranks


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_norm`` from 0 to 1; null where all values are equal."""
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))  # one row
    return out.select(*df.columns, *[((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0).cast(df.schema[c].dataType))).alias(f"{c}_norm") for c in columns])


def ranked_many(df: DataFrame, values: dict[str, Column], null_at: dict[str, Column] | None = None) -> DataFrame:
    """Ranks of all rows by each of several values, from the largest; gaps after ties, nulls first.

    A rank is null where ``null_at`` holds, though such rows keep their places.  All ranks come
    from one table of how often each value occurs, dealt by range: places are the counts of
    earlier values, so that no task sorts all rows.
    """
    names = list(values)
    rows = cut(df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_v", F.array(*[F.struct(F.lit(n).alias("rank"), values[n].cast("double").alias("v")) for n in names])))
    long = rows.select("_id", F.explode("_v").alias("_e")).select("_id", "_e.rank", "_e.v")
    counts = long.groupBy("rank", "v").agg(F.count(F.lit(1)).alias("_n"))
    counts = with_dense_id(counts, ["rank", F.col("v").desc_nulls_first()], "_order").withColumn("_chunk", F.floor(F.col("_order") / 65536))
    sums = counts.groupBy("_chunk").agg(F.sum("_n").alias("_s"))
    starts = sums.select("_chunk", F.coalesce(F.sum("_s").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_chunk").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = {n: i for i, n in enumerate(sorted(names))}  # each rank's places follow those of the ranks before it
    shift = F.create_map(*[F.lit(x) for n, i in every.items() for x in (n, i)])[F.col("rank")]
    total = rows.agg(F.count(F.lit(1)).alias("_all"))  # one row
    places = counts.withColumn("_inside", inside).join(starts, "_chunk").crossJoin(F.broadcast(total)).select("rank", F.col("v").alias("_w"), (F.col("_inside") + F.col("_before") + 1 - shift * F.col("_all")).alias("_place"))
    places = places.withColumnRenamed("rank", "_r")
    if counts.limit(MOST_VALUES + 1).count() <= MOST_VALUES:  # else adaptive execution splits the commonest values
        places = F.broadcast(places)
    placed = long.join(places, (F.col("rank") == F.col("_r")) & F.col("v").eqNullSafe(F.col("_w")))
    wide = placed.groupBy("_id").pivot("rank", names).agg(F.first("_place"))
    out = rows.drop("_v", *names).join(wide, "_id").drop("_id")
    return out.withColumns({n: F.when(~F.coalesce(c, F.lit(False)), F.col(n)) for n, c in (null_at or {}).items()})


def ranked(df: DataFrame, value: Column | str, name: str, null_at: Column | None = None, partition: Sequence[str] = ()) -> DataFrame:
    """One rank, as in ``ranked_many``; or within each partition."""
    v = col(value)
    if not partition:
        return ranked_many(df, {name: v}, {} if null_at is None else {name: null_at})
    place = F.rank().over(Window.partitionBy(*partition).orderBy(v.desc_nulls_first()))
    return df.withColumn(name, place if null_at is None else F.when(~F.coalesce(null_at, F.lit(False)), place))


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """The number of rows beside each row, to be taken before a limit."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))  # one row

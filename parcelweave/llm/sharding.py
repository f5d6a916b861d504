"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in Spark expressions only.

The key and the number of shards alone decide, without a ring table; with one more shard, rows
move only into it.  Law ``key``.  Multiplication modulo 2^64 is done on 32- and 16-bit halves,
since Spark's own raises on overflow.

Edge cases: a null key falls back to the hash of its text, so that such rows spread; a null text
has no bytes; rows that repeat an id share a shard and have a slot each, ordered by text and
content; a text of any length is read whole and only measured; an empty table gives an empty
result; other columns are ignored, or carried as ``payload`` under names that don't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelweave.llm.common import carried, content, place
from parcelweave.storage import materialize

#: Of the published algorithm: the multiplier of its generator.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
#: Names of the result; a payload column of such a name, in any case, gets ``source_`` before it.
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Ranges that rows alike in all columns are spread over.
SPREAD = 4096


def _times(half: Column, by: int) -> Column:
    """``half * by`` modulo 2^32, of two numbers under 2^32."""
    low, high = half.bitwiseAND(0xFFFF), F.shiftright(half, 16)
    return (low * by + F.shiftleft((high * by).bitwiseAND(0xFFFF), 16)).bitwiseAND(LOW)


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of ``key * MULTIPLIER + 1`` modulo 2^64."""
    by_high, by_low = MULTIPLIER >> 32, MULTIPLIER & LOW
    upper = F.shiftright(low, 16) * by_low
    total = low.bitwiseAND(0xFFFF) * by_low + 1 + F.shiftleft(upper.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    return (_times(high, by_low) + _times(low, by_high) + carry).bitwiseAND(LOW), total.bitwiseAND(LOW)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key, from 0 to ``shards - 1``."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    if shards == 1:
        return F.lit(0)
    key = key.cast("long")
    high, low = _next(F.shiftrightunsigned(key, 32), key.bitwiseAND(LOW))
    start = F.struct(high.alias("high"), low.alias("low"), F.lit(0).cast("long").alias("shard"))

    def step(state: Column, _: Column) -> Column:
        jump = ((state["shard"] + 1) * (F.lit(2147483648.0) / (F.shiftright(state["high"], 1) + 1))).cast("long")
        high, low = _next(state["high"], state["low"])
        return F.when(jump < shards, F.struct(high.alias("high"), low.alias("low"), jump.alias("shard"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards - 1)), start, step, lambda state: state["shard"].cast("int"))


def _names(id_col: str, payload: Sequence[str]) -> list[str]:
    """Payload names that clash neither with the result nor with each other, whatever their case."""
    used, out = {id_col.lower(), *RESULT}, []
    for name in payload:
        while name.lower() in used:
            name = f"source_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", payload: Sequence[str] = ()) -> DataFrame:
    """``(id_col, *payload, size, text_crc32, law, shard, slot, grown_shard)``, one row for each row of ``docs``.

    One range exchange brings each shard's rows together in the order of their ids, over as many
    partitions as the shard needs; rows that repeat an id follow each other by text and content, and
    such as are alike in all columns are dealt at random, so that no partition has to hold them all.
    A row's slot is its place in its partition plus the rows of its shard in earlier partitions; those
    counts are a row for each partition and shard.
    """
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    own = F.col("_id").cast("long") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.when(F.col("_id").isNotNull(), F.xxhash64("_id"))
    key = F.coalesce(own, F.xxhash64(text))
    extra = [f"_row.{place(docs, c)}" for c in payload]
    rows = carried(docs, _id=id_col, _text=text_col).select(
        "_id",
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate(extra)],
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        content(docs).alias("_content"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).alias("_spread"),
    )
    order = ["shard", "_id", "text_crc32", "size", "_content"]
    dealt = rows.repartitionByRange(*order, "_spread").sortWithinPartitions(*order).drop("_content", "_spread")
    placed = materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "shards")
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_part", (before - F.col("_first")).alias("_base"))
    # at most a row for each shard and partition
    made = placed.join(F.broadcast(starts), ["shard", "_part"]).select(
        "_id", *[f"_p{i}" for i in range(len(extra))], "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_at") + F.col("_base")).alias("slot"), "grown_shard"
    )
    return made.toDF(id_col, *_names(id_col, payload), *RESULT)


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet, one folder for each shard, in slot order inside a file."""
    payload = tuple(c for c in docs.columns if c != id_col)
    assign(docs, shards, id_col, text_col, payload).write.partitionBy("shard").parquet(path)

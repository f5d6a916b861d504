"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification, components.

``fingerprints`` is one pass over whole texts.  ``links`` deals every distinct fingerprint to
all choices of blocks that a close pair must share, and verifies candidates inside a bucket by
popcount.  ``classes`` turns links into components.

Edge cases: a null, empty or blank text has fingerprint zero and is linked like any other; a text
of any length is read whole; a null id keeps its row and takes part in no minimum; repeated rows
keep one row each; rows that share an id and differ in text go by their own texts; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelweave.llm.common import carried, content, take, uncarried
from parcelweave.operators.components import connected_components
from parcelweave.shipping import ship
from parcelweave.storage import discard, materialize, scope

BITS = 64
#: Members of a bucket that one task compares at a time; larger buckets are dealt to cells of two chunks.
CHUNK = 4096
#: Keys of oversized buckets that may be broadcast (two longs each).
MOST_BROADCAST = 100_000


def shingle_hashes(text: bytes | None, width: int, seed: int) -> list[int]:
    """XXH64 of each ``width``-word shingle, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, len(values), 1 << 15):
        part = values[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """``(id, txt, fp)`` for every row: ``txt`` is a hash of the text, ``fp`` the unsigned fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            found = np.fromiter((majority(shingle_hashes(x.as_py(), width, seed)) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "txt", "fp"])

    ship(docs.sparkSession)
    frame = take(docs, id=id_col, text=text_col).select("id", F.xxhash64(F.col("text").cast("string")).alias("txt"), F.col("text").cast("string"))
    return frame.mapInArrow(run, T.StructType([*frame.schema[:2], T.StructField("fp", T.LongType())]))


def block_masks(n: int, distance: int = 4, crowd: int = 8) -> list[int]:
    """Masks of which a pair within ``distance`` agrees on at least one.

    The bits are cut into ``b`` blocks; at most ``distance`` of them differ, so that some
    ``b - distance`` agree.  ``b`` grows with the number of fingerprints, so that a bucket of
    evenly spread fingerprints holds about ``crowd`` of them at any size.
    """
    b = distance + 1
    while b < 2 * distance + 2 and n >> (BITS * (b - distance) // b) > crowd:
        b += 1
    return chosen_blocks(b, distance)


def chosen_blocks(b: int, distance: int) -> list[int]:
    """All choices of ``b - distance`` of ``b`` blocks of bits, as masks."""
    cuts = [BITS * i // b for i in range(b + 1)]
    blocks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(b)]
    return [sum(x) for x in combinations(blocks, b - distance)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _spanning(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of at most ``distance`` that connect all members of one bucket that any such edges connect."""
    out, rest = [], values
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                hit = rest[near]
                out.extend((int(x), int(y)) for y in hit)
                queue.extend(hit)
                rest = rest[~near]
    return out


def _bucket_links(keys: np.ndarray, marks: np.ndarray, fps: np.ndarray, masks: np.ndarray, distance: int) -> np.ndarray:
    """Links inside the buckets of rows sorted by key; a pair that an earlier mask also brings together is left to it."""
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    found = []
    two = bounds[:-1][sizes == 2]
    if len(two):
        x, y = fps[two], fps[two + 1]
        near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
        found.append(np.column_stack((x[near], y[near], marks[two][near].astype(np.uint64))))
    for k in np.flatnonzero(sizes > 2):
        lo, hi = bounds[k], bounds[k + 1]
        if edges := _spanning(np.unique(fps[lo:hi]), distance):
            found.append(np.column_stack((np.array(edges, np.uint64), np.full(len(edges), marks[lo], np.uint64))))
    if not found:
        return np.zeros((0, 2), np.uint64)
    all_edges = np.concatenate(found)
    differ, own = all_edges[:, 0] ^ all_edges[:, 1], all_edges[:, 2]
    first = np.full(len(differ), len(masks), np.uint64)
    for i in range(len(masks) - 1, -1, -1):
        first[(differ & masks[i]) == 0] = i
    return all_edges[first == own][:, :2]


def _keys(rows: DataFrame, masks: list[int], *before: str) -> DataFrame:
    """``(key, mark, fp)``: a row for each mask, with a key of ``before`` and what the mask shows of the fingerprint."""
    own = [F.struct(F.lit(i).alias("at"), F.xxhash64(*before, F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("key")) for i, m in enumerate(masks)]
    return rows.select(F.explode(F.array(*own)).alias("b"), *[c for c in rows.columns if c not in ("key",)])


def _sized(rows: DataFrame, over: int, label: str) -> tuple[DataFrame, int]:
    """The keys of more than ``over`` rows with their ``size``, and their number; broadcast where they are few."""
    crowded = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > over), label)
    many = crowded.count()
    return F.broadcast(crowded) if many <= MOST_BROADCAST else crowded, many


def links(distinct: DataFrame, n: int, distance: int = 4, fp: str = "fp", chunk: int = CHUNK) -> DataFrame:
    """``(src, dst)``: enough pairs of fingerprints at most ``distance`` bits apart to connect all that such pairs connect.

    ``distinct`` holds each fingerprint once, ``n`` is their number.  Where fingerprints are not
    spread evenly a bucket may be large: its members get keys of further blocks, as a pair within
    the distance agrees on half of ``2 * distance`` blocks, too.  What is still over ``chunk`` is dealt
    to cells of two of its chunks each, so that every pair of members meets in a cell and no task holds
    a bucket of unbounded size.
    """
    ship(distinct.sparkSession)
    masks, further = block_masks(n, distance), chosen_blocks(2 * distance, distance)
    unsigned = np.array(masks, np.uint64)
    rows = _keys(distinct.select(F.col(fp).alias("fp")), masks).select("b.key", F.col("b.at").alias("mark"), "fp")
    huge, many = _sized(rows, chunk * len(further), "huge")
    if many:
        marked = rows.join(huge, "key", "left")
        refined = _keys(marked.where("size IS NOT NULL").withColumnRenamed("key", "outer").drop("size"), further, "outer").select("b.key", "mark", "fp")
        rows = marked.where("size IS NULL").select("key", "mark", "fp").unionByName(refined)
    small, many = _sized(rows, chunk, "crowded")
    if many:
        cells = F.ceil(F.col("size") / chunk).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), cells).cast("int")
        dealt = rows.join(small, "key", "left").withColumn("cells", F.coalesce(cells, F.lit(1))).withColumn("own", F.coalesce(own, F.lit(0)))
        rows = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(
            F.when(F.col("cells") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "mark", "fp"
        )

    def run(batches):
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)]

        def told(parts):
            edges = _bucket_links(*parts, unsigned, distance)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, i].astype(np.uint64).view(np.int64)) for i in (0, 1)], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            parts[2] = parts[2].view(np.uint64)
            parts = [np.concatenate(x) for x in zip(kept, parts, strict=True)]
            last = int(np.searchsorted(parts[0], parts[0][-1], "left"))
            kept = [x[last:] for x in parts]
            if last:
                yield told([np.ascontiguousarray(x[:last]) for x in parts])
        if len(kept[0]):
            yield told([np.ascontiguousarray(x) for x in kept])

    dealt = rows.select("key", "mark", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "src long, dst long")


def roots(distinct: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """``(fp, root)`` of each of the ``n`` fingerprints of ``distinct`` that has another within ``distance``: the smallest that is reached."""
    with scope() as own:
        edges = links(distinct, n, distance)
    found = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))  # a checkpoint
    discard(*own)
    return found


def _placed(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """``(id, txt, fp)`` of every row, and ``(fp, component_id, first)`` of every fingerprint: its component's smallest id and ``first_row``."""
    marked = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("first_id"), first_row().alias("first")), "distinct")
    found = roots(distinct, distinct.count(), distance)
    return marked, owners(distinct, "fp", found)


def first_row() -> Column:
    """What the row of a group that stays is known by: the smallest id, then the smallest hash of a text; null ids come last."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "txt"))


def owners(distinct: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``(key, component_id, first)`` for each row of ``distinct``, from the ``(key, root)`` of those that are linked."""
    members = distinct.join(found, key)
    lowest = members.groupBy("root").agg(F.min("first_id").alias("_lowest"), F.min("first").alias("_first"))
    linked = members.join(lowest, "root").select(key, "_lowest", "_first")
    rows = distinct.join(linked, key, "left")
    return rows.select(key, F.when(F.col("_first").isNull(), F.col("first_id")).otherwise(F.col("_lowest")).alias("component_id"), F.coalesce("_first", "first").alias("first"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """``(id_col, fingerprint, component_id)``, one row for each row of ``docs``."""
    marked, placed = _placed(docs, id_col, text_col, width, distance)
    return marked.join(placed, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id, of several texts under it that with the smallest hash."""
    return first_rows(docs, _placed(docs, id_col, text_col, width, distance)[1], id_col, text_col)


def first_rows(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are ``first`` in ``placed``, once each; of rows alike in id and text, that of the smallest content.

    Winners are chosen on hashes alone.  Rows that agree in everything are reduced in each task
    before they meet, however many there are.
    """
    wanted = placed.select(F.struct(F.col("first.id").alias("id"), F.col("first.txt").alias("txt")).alias("_key")).distinct()
    rows = carried(docs, id=id_col, text=text_col).select("_row", F.struct("id", F.xxhash64(F.col("text").cast("string")).alias("txt")).alias("_key"), content(docs).alias("_content"))
    counts = rows.select("_key", "_content").join(wanted, "_key", "left_semi").groupBy("_key", "_content").agg(F.count(F.lit(1)).alias("n"))
    least = counts.groupBy("_key").agg(F.min(F.struct("_content", "n")).alias("_w"))
    winners = materialize(least.select("_key", "_w._content", F.col("_w.n").alias("n")), "winners")
    single = rows.join(winners.where("n = 1").select("_key", "_content"), ["_key", "_content"], "left_semi").select("_row")
    several = rows.join(winners.where("n > 1").select("_key", "_content"), ["_key", "_content"], "left_semi")
    once = several.groupBy("_key", "_content").agg(F.first("_row").alias("_row")).select("_row")
    return uncarried(single.unionByName(once), docs)

"""Near-duplicates by content: five-word shingles in common, at a Jaccard similarity of 0.8 or more.

Texts with the same set of shingles are one set.  SimHash comes first: sets whose fingerprints are
connected by steps of at most ``DISTANCE`` bits are a bucket.  A pair at 0.8 differs in about 10 bits,
beyond what blocks of 64 can find, so that sets that share a band of ``ROWS`` MinHashes are buckets,
too; with ``BANDS`` bands a pair at 0.8 misses all of them with a probability of
(1 - 0.8 ** 4) ** 26, about one in a million, and closer pairs less often.  Every link is verified
on the sets of 64-bit hashes.  First each set is compared to the smallest of each of its buckets,
which settles most buckets; in the others, every two sets that are not connected yet are compared.

Edge cases: a text of under five words has one shingle, all its words; null, empty and blank texts
have none and are copies of each other; a text of any length is read whole; rows that share an id and
differ in text go by their own texts; a null id is larger than any other and takes part in no minimum;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelweave.llm.common import parts, take
from parcelweave.llm.simhash import first_row, first_rows, majority, owners, roots, shingle_hashes
from parcelweave.operators.components import connected_components
from parcelweave.shipping import ship
from parcelweave.storage import discard, materialize

WIDTH = 5
#: Bits by which fingerprints may differ in a step.
DISTANCE = 4
BANDS, ROWS = 26, 4
#: Members of a bucket, and their hashes, that are compared at a time; larger buckets are dealt to cells of two such chunks.
CHUNK, CHUNK_HASHES = 512, 500_000
#: Texts that may be picked by a broadcast of their hashes (one long each).
MOST_BROADCAST = 500_000

_R = random.Random(42)
TIMES, PLUS, MIX = (np.array([_R.getrandbits(64) | 1 for _ in range(BANDS * ROWS)], np.uint64) for _ in range(3))


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.array(shingle_hashes(text, WIDTH, 42), np.uint64))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(hashes):
        return hashes
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024] * TIMES[:, None] + PLUS[:, None]).min(axis=1), out=least)
    return (least * MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, txt, sid, n, fp, keys)`` of every row: hash of the text, set, its size, its fingerprint and its bands."""

    def run(batches):
        for batch in parts(batches, 2):
            sets = [shingles(x.as_py()) for x in batch.column(2).cast(pa.large_binary())]
            keys = [band_keys(x) for x in sets]
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            sids = np.fromiter(map(set_id, sets), np.uint64, len(sets)).view(np.int64)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            fps = np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids), pa.array(sizes), pa.array(fps), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "txt", "sid", "n", "fp", "keys"])

    ship(docs.sparkSession)
    frame = take(docs, id=id_col, text=text_col).select("id", F.xxhash64(F.col("text").cast("string")).alias("txt"), F.col("text").cast("string"))
    return frame.mapInArrow(run, T.StructType([frame.schema[0], *T.StructType.fromDDL("txt long, sid long, n long, fp long, keys array<long>").fields]))


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``(sid, hashes)`` of the wanted texts."""

    def run(batches):
        for batch in parts(batches, 0):
            sets = [shingles(x.as_py()) for x in batch.column(0).cast(pa.large_binary())]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            sids = np.fromiter(map(set_id, sets), np.uint64, len(sets)).view(np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["sid", "hashes"])

    picked = F.broadcast(wanted) if wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else wanted
    texts = take(docs, text=text_col).select(F.col("text").cast("string")).withColumn("txt", F.xxhash64("text")).join(picked, "txt", "left_semi")
    return texts.select("text").mapInArrow(run, "sid long, hashes array<long>").groupBy("sid").agg(F.first("hashes").alias("hashes"))


def _bucket_links(sids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
    """Links of similar sets of one bucket that connect all roots that any such links connect."""
    tokens, starts = np.unique(flat, return_inverse=True)[1], np.concatenate(([0], np.cumsum(sizes)))
    kinds = np.unique(roots, return_inverse=True)[1]
    waiting, held, out = np.ones(len(sids), bool), np.zeros(len(flat), bool), []
    while waiting.any():
        queue = np.flatnonzero(kinds == kinds[np.argmax(waiting)]).tolist()
        waiting[queue] = False
        while queue and waiting.any():
            x = queue.pop()
            near = waiting & (5 * np.minimum(sizes, sizes[x]) >= 4 * np.maximum(sizes, sizes[x]))
            if not near.any():
                continue
            own = tokens[starts[x] : starts[x + 1]]
            held[own] = True
            shared = np.add.reduceat(held[tokens], starts[:-1], dtype=np.int64)
            held[own] = False
            near &= 9 * shared >= 4 * (sizes + sizes[x])
            if near.any():
                out.extend((int(sids[x]), int(y)) for y in sids[near])
                more = waiting & np.isin(kinds, kinds[near])
                waiting &= ~more
                queue.extend(np.flatnonzero(more).tolist())
    return out


def _within(rows: DataFrame, sets: DataFrame, chunk: int) -> DataFrame:
    """``(src, dst)``: links inside the buckets of ``(key, sid, n, root)`` that join different roots."""
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("hashes")).where((F.col("size") > chunk) | (F.col("hashes") > CHUNK_HASHES))
    cells = F.least(F.col("size"), F.greatest(F.ceil(F.col("size") / chunk), F.ceil(F.col("hashes") / CHUNK_HASHES))).cast("int")
    dealt = rows.join(crowded, "key", "left").withColumn("cells", F.coalesce(cells, F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = dealt.select(F.when(F.col("cells") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "sid", "root")

    def run(batches):
        def told(table):
            keys, sids, roots = (table.column(i).to_numpy() for i in range(3))
            lists = table.column(3).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            links = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if (roots[lo:hi] != roots[lo]).any():
                    links += _bucket_links(sids[lo:hi], roots[lo:hi], np.diff(offsets[lo : hi + 1]).astype(np.int64), flat[offsets[lo] : offsets[hi]])
            found = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], names=["src", "dst"])

        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            keys = table.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1], "left"))
            kept = table.slice(last)
            if last:
                yield told(table.slice(0, last).combine_chunks())
        if kept is not None:
            yield told(kept.combine_chunks())

    ship(rows.sparkSession)
    return dealt.join(sets, "sid").select("key", "sid", "root", "hashes").repartition("key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long")


def fingerprint_buckets(distinct: DataFrame) -> DataFrame:
    """``(key, sid, n)``: a key for all sets whose fingerprints are connected by steps of at most ``DISTANCE`` bits."""
    fps = materialize(distinct.where("n > 0").select("fp").distinct(), "fingerprints")
    near = roots(fps, fps.count(), DISTANCE)
    rows = distinct.where("n > 0").join(near, "fp", "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"), "sid", "n")
    discard(fps)  # ``near`` is a checkpoint
    return rows


def _connected(distinct: DataFrame, docs: DataFrame, text_col: str, chunk: int) -> DataFrame:
    """``(sid, root)`` of all sets that have a link."""
    rows = distinct.select(F.explode("keys").alias("key"), "sid", "n").unionByName(fingerprint_buckets(distinct))
    shared = rows.groupBy("key").agg(F.min(F.struct("sid", "n")).alias("low"), F.max("sid").alias("high")).where("low.sid <> high")
    members = materialize(rows.join(shared.select("key", "low"), "key"), "members")
    wanted = materialize(members.select("sid").distinct().join(distinct.select("sid", "txt"), "sid").select("txt"), "wanted")
    sets = materialize(_sets(docs, wanted, text_col), "sets")

    stars = members.where("sid <> low.sid AND 5 * least(n, low.n) >= 4 * greatest(n, low.n)").select("sid", F.col("low.sid").alias("to"), "n", F.col("low.n").alias("m")).distinct()
    stars = stars.join(sets, "sid").join(sets.toDF("to", "others"), "to")
    first = materialize(stars.where(9 * F.size(F.array_intersect("hashes", "others")) >= 4 * (F.col("n") + F.col("m"))).select(F.col("sid").alias("src"), F.col("to").alias("dst")), "stars")
    roots = materialize(connected_components(first), "roots").toDF("sid", "root")
    placed = materialize(members.select("key", "sid", "n").join(roots, "sid", "left").select("key", "sid", "n", F.coalesce("root", "sid").alias("root")), "placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    waiting = materialize(placed.join(open_, "key", "left_semi"), "open")
    found = connected_components(first.unionByName(_within(waiting, sets, chunk))).toDF("sid", "root")
    discard(members, wanted, sets, first, roots, placed, waiting)  # ``found`` is a checkpoint
    return found


def _placed(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    marked = materialize(_marked(docs, id_col, text_col), "marked")
    distinct = marked.groupBy("sid").agg(F.min("id").alias("first_id"), first_row().alias("first"), F.first("txt").alias("txt"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    distinct = materialize(distinct, "distinct")
    return marked, owners(distinct.select("sid", "first_id", "first"), "sid", _connected(distinct, docs, text_col, chunk))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(id_col, component_id)``, one row for each row of ``docs``; the component's smallest id names it."""
    marked, placed = _placed(docs, id_col, text_col, chunk)
    return marked.select("id", "sid").join(placed, "sid").select(F.col("id").alias(id_col), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id, of several texts under it that with the smallest hash."""
    return first_rows(docs, _placed(docs, id_col, text_col, chunk)[1], id_col, text_col)

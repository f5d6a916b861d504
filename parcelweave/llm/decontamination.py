"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

A test item is much shorter than a document, so that their Jaccard similarity says little and
banded signatures of whole documents would miss most leaks.  The search is one of containment:
an item is represented by its MinHash sketch, the smallest of its shingle hashes, and a document
answers whether it contains each.  Items are partitioned by size.  For a size class of
``[2^k, 2^(k+1))`` distinct shingles the sketch holds ``s = u - ceil(t u) + 1`` hashes with
``u = 2^(k+1) - 1``: an item of which at least ``t`` is contained lacks at most ``s - 1``
shingles, so that at least one of its sketch is met.  The search thus misses nothing.  A document
with fewer distinct shingles than a class needs is not searched for that class.  An item of fewer
words than a shingle is one shingle of its own length, and documents are shingled at such lengths, too.

The test items are the query set.  Up to ``BLOCK_SHINGLES`` shingles of them are held by every
executor, and one pass over the documents, without a shuffle, both retrieves and verifies on the
shingles' own words.  More items are not dealt to several such passes: then the documents are
shingled once, those of their hashes that may be in a sketch are joined to the sketches by equality,
and the pairs that meet are joined back to their texts and verified.

Words are runs of non-space characters, lower-cased, without ASCII punctuation.  Edge cases: null
or empty texts have no words and meet nothing; texts of any length are read whole; repeated items and
documents, also under one id, each give their own rows; rows with a null id are searched, too; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelweave.llm.common import carried, map_rows, take, uncarried
from parcelweave.shipping import ship
from parcelweave.storage import materialize

#: Shingles of test items up to which they are sent to every executor, about 100 bytes each.
BLOCK_SHINGLES = 500_000
#: A fixed table of 2^24 slots that tells in one step that a hash is in no sketch.
SLOT_BITS = 24
#: Texts that may be picked by a broadcast of their hashes (one long each).
MOST_BROADCAST = 500_000

_DROP = string.punctuation.encode()


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _DROP).split() if text else []


def shingles_of(words: list[bytes], width: int) -> tuple[bytes, list[int], list[int]]:
    """The joined words, and where each shingle starts and ends in them; none of fewer words."""
    joined = b" ".join(words)
    if len(words) < width:
        return joined, [], []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return joined, (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()


def item_shingles(text: str | None, width: int) -> frozenset[bytes]:
    """The distinct shingles of a test item; a shorter one is its whole sequence."""
    words = words_of(text)
    joined, starts, ends = shingles_of(words, min(width, len(words)) or 1)
    return frozenset(joined[a:b] for a, b in zip(starts, ends, strict=True))


def needed(n: int, threshold: float) -> int:
    """The fewest of ``n`` shingles that make up ``threshold`` of them."""
    return max(1, int(np.ceil(n * threshold - 1e-9)))


def sketch_size(n: int, threshold: float) -> int:
    """Hashes in the sketch of an item of ``n`` shingles, the same for its size class."""
    top = (1 << n.bit_length()) - 1
    return min(n, top - needed(top, threshold) + 1)


def sketch_of(own: frozenset[bytes], threshold: float) -> list[int]:
    return sorted(map(xxhash.xxh64_intdigest, own))[: sketch_size(len(own), threshold)]


class Slots:
    """Which hashes may be in a sketch; and the lengths of the shingles of short items."""

    def __init__(self):
        self.bits = np.zeros((1 << SLOT_BITS) // 64, np.uint64)
        self.short: set[int] = set()

    def add(self, hashes: list[int]) -> None:
        at = np.array(hashes, np.uint64) >> np.uint64(64 - SLOT_BITS)
        np.bitwise_or.at(self.bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def met(self, words: list[bytes], width: int) -> tuple[set[int], int]:
        """The hashes of a text's shingles that may be in a sketch, and the number of its shingles of full width."""
        out: set[int] = set()
        full = 0
        for k in (*self.short, width):
            joined, starts, ends = shingles_of(words, k)
            if not starts:
                continue
            digest = xxhash.xxh64_intdigest
            found = np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
            at = found >> np.uint64(64 - SLOT_BITS)
            there = self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
            out.update(found[there.astype(bool)].tolist())
            full = len(starts) if k == width else full
        return out, full


def held(words: list[bytes], own: frozenset[bytes], width: int, cache: dict) -> int:
    """How many of an item's shingles a text holds; ``cache`` keeps the text's shingles by their length."""
    k = min(width, next(iter(own)).count(b" ") + 1)
    if k not in cache:
        joined, starts, ends = shingles_of(words, k)
        cache[k] = {joined[a:b] for a, b in zip(starts, ends, strict=True)}
    return len(own & cache[k])


class Items:
    """The sketches and shingles of test items that every executor holds."""

    def __init__(self, items: list[tuple[object, str | None]], width: int, threshold: float):
        self.width = width
        self.ids: list[object] = []
        self.sets: list[frozenset[bytes]] = []
        self.least: list[int] = []
        self.sketch: dict[int, list[int]] = {}
        self.slots = Slots()
        for key, text in items:
            own = item_shingles(text, width)
            if not own:
                continue
            at = len(self.ids)
            self.ids.append(key)
            self.sets.append(own)
            self.least.append(needed(len(own), threshold))
            hashes = sketch_of(own, threshold)
            self.slots.add(hashes)
            if (k := len(words_of(text))) < width:
                self.slots.short.add(k)
            for h in hashes:
                self.sketch.setdefault(h, []).append(at)

    def search(self, text: str | None) -> list[tuple[int, int]]:
        """Items of which the text holds enough, and how many of their shingles it holds."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        met, full = self.slots.met(words, self.width)
        asked = {at for h in met for at in self.sketch.get(h, ()) if self.least[at] <= max(1, full)}
        cache: dict[int, set[bytes]] = {}
        found = ((at, held(words, self.sets[at], self.width, cache)) for at in sorted(asked))
        return [(at, n) for at, n in found if n >= self.least[at]]


def _held_by_all(items: DataFrame, width: int, threshold: float, most: int) -> Items | None:
    """The items, if they have at most ``most`` words; read one partition at a time and no further than that."""
    rows, size = [], 0
    for key, text in items.toLocalIterator():
        rows.append((key, text))
        size += len(words_of(text)) + 1
        if size > most:
            return None
    return Items(rows, width, threshold)


def _item_rows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return take(benchmark, item=item_col, text=text_col).select("item", F.col("text").cast("string"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8, most: int = BLOCK_SHINGLES) -> DataFrame:
    """``(id_col, item_col, n_shared, n_item, containment)`` for each document and item contained in it."""
    ship(docs.sparkSession)
    items = _item_rows(benchmark, item_col, item_text_col)
    frame = take(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string"))
    counted = [T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("containment", T.DoubleType())]
    held_items = _held_by_all(items, width, threshold, most)
    if held_items is None:
        texts = frame.select("id", F.xxhash64("text").alias("txt"))
        rows = texts.join(_joined(frame, items, width, threshold), "txt").select("id", "item", "n_shared", "n_item", "containment")
        return rows.toDF(id_col, item_col, *[f.name for f in counted])
    schema = T.StructType([frame.schema[0], items.schema[0], *counted])
    target = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(held_items)

    def run(batches):
        own = sent.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, n in own.search(text.as_py()):
                    total = len(own.sets[at])
                    rows.append((key, own.ids[at], n, total, n / total))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

    return frame.mapInArrow(run, schema).toDF(id_col, item_col, *[f.name for f in counted])


def _joined(frame: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """``(txt, item, n_shared, n_item, containment)`` of each text, known by its hash, and row of ``items`` contained in it; by joins."""
    spark = frame.sparkSession
    # each row of items by a number; written, so that it stays the same
    known = materialize(items.withColumn("row", F.monotonically_increasing_id()), "items")

    def sketched(batches):
        for batch in batches:
            hashes, rows, short = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = item_shingles(text.as_py(), width)
                sketch = [x - (1 << 64) if x >> 63 else x for x in sketch_of(own, threshold)] if own else []
                hashes += sketch
                rows += [row] * len(sketch)
                short += [min(width, len(words_of(text.as_py())))] * len(sketch)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(rows, pa.int64()), pa.array(short, pa.int32())], names=["h", "row", "k"])

    sketches = materialize(known.select("row", "text").mapInArrow(sketched, "h long, row long, k int"), "sketches")
    slots = Slots()
    slots.short = {r["k"] for r in sketches.select("k").distinct().collect() if r["k"] < width}  # fewer than ``width``
    taken = sketches.select(F.shiftrightunsigned("h", 64 - SLOT_BITS).alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(s & 63L AS INT)))").alias("bits"))
    found = taken.toPandas()  # a row for each 64 slots at most
    slots.bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(slots)

    def shingled(batches):
        for batch in batches:
            hashes, texts = [], []
            for txt, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                found = sent.value.met(words, width)[0] if words else ()
                hashes += [x - (1 << 64) if x >> 63 else x for x in found]
                texts += [txt] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(texts, pa.int64())], names=["h", "txt"])

    hashed = frame.select(F.xxhash64("text").alias("txt"), "text")
    pairs = hashed.mapInArrow(shingled, "h long, txt long").distinct().join(sketches.select("h", "row"), "h").select("txt", "row").distinct()
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select("txt").distinct()
    wanted = F.broadcast(wanted) if wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else wanted
    once = hashed.join(wanted, "txt", "left_semi").groupBy("txt").agg(F.first("text").alias("text"))
    both = pairs.join(once, "txt").join(known.select("row", F.col("text").alias("item_text")), "row").repartition("txt").sortWithinPartitions("txt")

    def verified(batches):
        last, words, cache = None, [], {}
        for batch in batches:
            out = []
            for row, txt, text, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if txt != last:
                    last, words, cache = txt, words_of(text.as_py()), {}
                own = item_shingles(item.as_py(), width)
                if (n := held(words, own, width, cache)) >= needed(len(own), threshold):
                    out.append((txt, row, n, len(own), n / len(own)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["txt", "row", "n_shared", "n_item", "containment"])

    found = both.select("row", "txt", "text", "item_text").mapInArrow(verified, "txt long, row long, n_shared long, n_item long, containment double")
    return found.join(known.select("row", "item"), "row").drop("row")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8, most: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs`` that contain no test item; a narrow pass, or a join where there are many items."""
    ship(docs.sparkSession)
    items = _item_rows(benchmark, item_col, item_text_col)
    held_items = _held_by_all(items, width, threshold, most)
    if held_items is None:
        rows = carried(docs, text=text_col).select("_row", F.xxhash64(F.col("text").cast("string")).alias("txt"))
        found = _joined(take(docs, text=text_col).select(F.col("text").cast("string")), items, width, threshold)
        return uncarried(rows.join(found.select("txt").distinct(), "txt", "left_anti"), docs)
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(held_items)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not sent.value.search(x.as_py()) for x in batch.column(at)], pa.bool_()))

    return map_rows(docs, run)

"""Best-fit packing by patterns of lengths (after Krell et al., 2021).

A document's ids end with ``end_id``; only a document longer than a sequence is cut.  How pieces are
packed depends on the histogram of their lengths alone, which has at most one entry for each length, so
that it is planned on the driver:

* patterns of two and three lengths that fill a sequence exactly are enumerated,
* how often to repeat each is fitted to the histogram by non-negative least squares, one
  coordinate at a time (Franc et al., 2005), longer lengths weighing more, as they are harder to place,
* repeats are rounded to what the histogram still holds,
* the residue, mostly short pieces, goes by falling length into the fullest sequence with room, in
  bulk: so many sequences alike, and so many pieces alike, at a time.

The plan gives each length runs of places.  A piece's place is its rank among those of its length:
its rank in the task that cut it, plus those of earlier tasks.  No length is gathered, however
common it is.

Edge cases: a null text is empty, and an empty document is its end id alone; texts of any length are
encoded whole; null and repeated ids and repeated rows are documents of their own; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from parcelweave.llm.common import take
from parcelweave.shipping import ship
from parcelweave.storage import materialize

#: Patterns that are fitted; of more, evenly spaced ones.
MOST_PATTERNS = 60_000
SWEEPS = 6
#: Encoded strings, and parts of strings, that a worker keeps.
MOST_KEPT = 700_000

# encoding

#: Strings of these characters are their own NFC, and become lower case one character at a time.
SIMPLE = re.compile("[!-~À-įĲ-ſ‐-‧]*")
#: How the vocabulary's rules cut such a string in lower case.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w]|_)+")


#: How the vocabulary spells bytes: printable Latin-1 characters stand for themselves, the others for the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELT = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class _Kept(dict):
    """What a function gave for short strings, and gives for others."""

    def __init__(self, made):
        self.made = made

    def __missing__(self, key: str) -> bytes:
        value = self.made(key)
        if len(key) <= 64:
            self[key] = value
        return value


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, by a tokenizer that drops white space and never joins across it."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(self.special) or r"(?!)")
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as this machine's unsigned ints, which must be little-endian and of 32 bits")
        self.chunks, self.parts = _Kept(self._chunk), _Kept(self._part)

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(SPELT)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if SIMPLE.fullmatch(chunk) and not self.special.search(chunk):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(chunk.lower())))
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        for kept in (self.chunks, self.parts):
            if len(kept) > MOST_KEPT:
                kept.clear()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One for each worker and vocabulary, so that what it has met serves its next tasks."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


# the plan


def enumerated(h: np.ndarray, size: int) -> np.ndarray:
    """Patterns of two or three lengths of the histogram that add up to ``size``, in falling order; 0 stands for no length."""
    there = h > 0
    found = []
    for a in np.flatnonzero(there)[::-1]:
        rest = size - int(a)
        if rest <= 0 or 3 * a < size:
            continue
        if rest <= a and there[rest]:
            found.append(np.array([[a, rest, 0]]))
        b = np.arange((rest + 1) // 2, min(int(a), rest - 1) + 1)
        b = b[there[b] & there[rest - b]]
        found.append(np.column_stack((np.full(len(b), a), b, rest - b)))
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return every[np.linspace(0, len(every) - 1, MOST_PATTERNS).astype(np.int64)] if len(every) > MOST_PATTERNS else every


def fitted(patterns: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Repeats of the patterns by weighted non-negative least squares, coordinate by coordinate."""
    left, x = h.astype(float).tolist(), [0.0] * len(patterns)
    left[0] = 0.0
    rows = []
    for a, b, c in patterns.tolist():
        uses: dict[int, int] = {}
        for length in (a, b, c):
            if length:
                uses[length] = uses.get(length, 0) + 1
        rows.append((list(uses.items()), sum(length * m * m for length, m in uses.items())))
    for _ in range(SWEEPS):
        for k, (uses, norm) in enumerate(rows):
            step = sum(length * m * left[length] for length, m in uses) / norm
            new = max(0.0, x[k] + step)
            if step := new - x[k]:
                x[k] = new
                for length, m in uses:
                    left[length] -= m * step
    return np.array(x)


def plan(h: np.ndarray, size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs of places ``(length, first rank, number, first sequence, in one sequence, offset)``, and the number of sequences.

    ``h[length]`` pieces of each length are placed.  A run's pieces fill ``in one sequence`` places
    next to each other of each of its sequences.
    """
    left = h.astype(np.int64).copy()
    groups: list[tuple[list[tuple[int, int]], int]] = [([(size, 1)], int(left[size]))] if left[size] else []
    left[size] = 0
    patterns = enumerated(left, size)
    x = fitted(patterns, left)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        uses: dict[int, int] = {}
        for length in patterns[k].tolist():
            if length:
                uses[length] = uses.get(length, 0) + 1
        n = min(int(np.rint(x[k])), *(int(left[length]) // m for length, m in uses.items()))
        if n > 0:
            groups.append((list(uses.items()), n))
            for length, m in uses.items():
                left[length] -= n * m
    groups += _best_fit(left, size)

    at, runs, base = {}, [], 0
    for content, n in groups:
        offset = 0
        for length, m in content:
            runs.append((length, at.get(length, 0), n * m, base, m, offset))
            at[length] = at.get(length, 0) + n * m
            offset += length * m
        base += n
    return runs, base


def _best_fit(left: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Pieces by falling length, each into the fullest sequence with room: ``(content, number)`` of sequences alike."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(room: int, content: list[tuple[int, int]], n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((content, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                content, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, content, many = size, [], n
            each = room // length
            full = min(many, n // each)
            put(room - each * length, [*content, (length, each)], full)
            n -= full * each
            many -= full
            if many and n and n < each:
                put(room - n * length, [*content, (length, n)], 1)
                n, many = 0, many - 1
            if content:  # else they are not begun
                put(room, content, many)
    return [x for room in rooms for x in open_[room]]


# documents


def pieces(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, part, at)``: ``at`` is a piece's rank among those of its length in task ``part``."""
    end = int(end_id).to_bytes(4, "little")
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        from pyspark import TaskContext

        encoder, part, seen = _encoder(shared.value), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows, columns = [], [[] for _ in range(6)]
            for i, text in enumerate(batch.column(1)):
                ids = memoryview(encoder.encode(text.as_py()) + end)
                for k, start in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[start : start + 4 * size]
                    length = len(own) // 4
                    at = seen[length] = seen.get(length, -1) + 1
                    rows.append(i)
                    for column, value in zip(columns, (k, start // 4, length, zlib.crc32(own), part, at), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, columns, kinds)], names=names)

    ship(docs.sparkSession)
    frame = take(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string"))
    schema = T.StructType([frame.schema[0], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long, part int, at long").fields])
    names = schema.names
    return frame.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``, one row for each piece.

    ``vocabulary`` is the path of a tokenizer's file on the driver.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    cut = materialize(pieces(docs, spec, id_col, text_col, size, end_id), "pieces")
    counts = materialize(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    h = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        h[length] = n
    runs = np.array(plan(h, size)[0], np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    key = runs[:, 0] << 40 | runs[:, 1]

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy() for i in (3, 5))
            own = runs[np.searchsorted(key, lengths << 40 | ranks, "right") - 1] if batch.num_rows else runs[:0]
            nth = ranks - own[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(own[:, 3] + nth // own[:, 4]), pa.array(own[:, 5] + nth % own[:, 4] * lengths)], names=names)

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(counts.select("part", "length", before.alias("before")).hint("merge"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("rank"))
    schema = T.StructType([T.StructField(id_col, cut.schema["id"].dataType), *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").fields])
    names = schema.names
    return ranked.mapInArrow(place, schema)

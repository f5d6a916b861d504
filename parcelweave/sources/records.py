"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks.

Spark cuts a file into splits at line ends, which may lie inside quotes.  A first narrow pass counts
each split's quotation marks; their running sum by file tells which splits begin inside quotes.  A
second narrow pass joins lines into records.  Where a record crosses the border of its split, its
fragments are put together by a group of their own.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelweave.shipping import ship
from parcelweave.storage import materialize

#: Splits that begin inside quotes, whose names (about 200 bytes each) go to all tasks.
MOST_INSIDE = 200_000

Places = list[int | None]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, value)``: the lines, in order within each split."""
    rows = spark.read.text(path, lineSep="\n")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches) -> Iterator[tuple[tuple[str, int], list[str], np.ndarray]]:
    """Lines and their numbers of quotation marks, by split."""
    for batch in batches:
        if batch.num_rows:
            files, starts = batch.column(0), batch.column(1).to_numpy()
            marks = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False)
            differ = pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False) | (starts[1:] != starts[:-1])
            bounds = [0, *(np.flatnonzero(differ) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                yield (files[lo].as_py(), int(starts[lo])), batch.column(2)[lo:hi].to_pylist(), marks[lo:hi]


def _probed(lines: DataFrame) -> DataFrame:
    """``(file, start, odd, header)``: whether a split has an odd number of quotation marks, and each file's first record."""

    def told(split, odd, header, ended):
        said = "\n".join(header) if split[1] == 0 and ended else None
        return pa.RecordBatch.from_arrays([pa.array([split[0]]), pa.array([split[1]], pa.int64()), pa.array([odd], pa.int32()), pa.array([said], pa.string())], names=["file", "start", "odd", "header"])

    def run(batches):
        at, odd, header, ended = None, 0, [], False
        for split, values, marks in _runs(batches):
            if split != at:
                if at is not None:
                    yield told(at, odd, header, ended)
                at, odd, header, ended = split, 0, [], split[1] > 0
            if not ended:
                whole = np.flatnonzero((odd + np.cumsum(marks)) % 2 == 0)
                header += values[: int(whole[0]) + 1 if len(whole) else len(values)]
                ended = len(whole) > 0
            odd = (odd + int(marks.sum())) % 2
        if at is not None:
            yield told(at, odd, header, ended)

    return lines.mapInArrow(run, "file string, start long, odd int, header string")


def _joined(batches, inside: frozenset[tuple[str, int]]) -> Iterator[tuple[tuple[str, int], int, list[str]]]:
    """Records by split: ``0`` with whole ones, ``-1`` with the rest of one begun before, ``1`` with one that doesn't end."""
    at, open_, begun, first = None, [], 0, False  # begun: inside quotes; first: what ends next began in an earlier split

    def rest():
        if open_:
            yield at, -1 if first else 1, ["\n".join(open_)]

    for split, values, marks in _runs(batches):
        if split != at:
            yield from rest()
            at, open_, begun, first = split, [], int(split in inside), split in inside
        if not begun and not marks.any():
            yield at, 0, values
            continue
        ends = np.flatnonzero((begun + np.cumsum(marks)) % 2 == 0).tolist()
        done, lo = [], 0
        for hi in ends:
            own = values[lo : hi + 1]
            done.append("\n".join(open_ + own) if open_ or len(own) > 1 else own[0])
            open_, lo = [], hi + 1
        if done and first:
            yield at, -1, done[:1]
            done, first = done[1:], False
        if done:
            yield at, 0, done
        open_ += values[lo:]
        begun = (begun + int(marks.sum())) % 2
    yield from rest()


def _parsed(records: list[str], n: int, places: Places, names: Sequence[str]) -> pa.RecordBatch:
    csv.field_size_limit((1 << 31) - 1)
    records = [r for r in records if r and r != "\r"]
    try:
        rows = list(csv.reader(records, strict=True, quoting=csv.QUOTE_NOTNULL))
    except csv.Error as e:
        raise ValueError(f"MALFORMED record: {e}") from e
    if len(rows) != len(records) or any(len(r) != n for r in rows):
        bad = next((r for r in rows if len(r) != n), rows[-1:])
        raise ValueError(f"MALFORMED record of {len(bad)} fields in place of {n}: {str(bad)[:200]}")
    columns = list(zip(*rows, strict=True)) or [()] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[p] if p is not None else [None] * len(rows), pa.string()) for p in places], names=list(names))


def read_records(spark: SparkSession, path: str, names: Sequence[str], places: Callable[[list[str], str], Places]) -> DataFrame:
    """The files' records as text columns ``names``; ``places`` says where a header, in a file, has each of them.

    Blank unquoted fields are null; quotation marks are doubled inside quotes; blank lines are passed
    over; a byte order mark before a header and carriage returns before line feeds are dropped.
    """
    ship(spark)
    probed = materialize(_probed(_lines(spark, path)), "splits")
    kinds: dict[str, tuple[int, Places]] = {}
    for file, header in probed.where("start = 0").select("file", "header").collect():  # a row for each file
        if header is None:
            raise ValueError(f"{file}: the header's quotation marks do not end")
        said = next(csv.reader([header.lstrip("\ufeff")], strict=True), [])
        kinds[file] = len(said), places(said, file)
    if not kinds:
        raise ValueError(f"{path} has no header")
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    begun = probed.select("file", "start", (before % 2).alias("inside")).where("inside = 1")
    found = begun.limit(MOST_INSIDE + 1).collect()
    if len(found) > MOST_INSIDE:
        raise ValueError(f"over {MOST_INSIDE} splits begin inside quotes; a larger spark.sql.files.maxPartitionBytes gives fewer")
    inside = frozenset((r.file, r.start) for r in found)
    schema = ", ".join(f"`{c}` string" for c in names)

    def whole(batches):
        begins = set()
        for split, kind, records in _joined(batches, inside):
            if split[1] == 0 and split not in begins:  # the header
                begins.add(split)
                records = records[1:] if kind == 0 else records
            if kind == 0 and records:
                yield _parsed(records, *kinds[split[0]], names)

    def broken(batches):
        for split, kind, records in _joined(batches, inside):
            if kind:
                yield pa.RecordBatch.from_arrays([pa.array([split[0]]), pa.array([split[1]], pa.int64()), pa.array([int(kind > 0)], pa.int32()), pa.array(records)], names=["file", "start", "begins", "text"])

    def mended(batches):
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _parsed([text], *kinds[file], names)

    # every pass reads the whole path: Spark's splits depend on the size of all that a scan reads, and a part of the files would be split elsewhere
    rows = _lines(spark, path).mapInArrow(whole, schema)
    if not inside:
        return rows
    parts = _lines(spark, path).mapInArrow(broken, "file string, start long, begins int, text string")
    parts = parts.withColumn("record", F.sum("begins").over(Window.partitionBy("file").orderBy("start", "begins")))
    texts = F.array_sort(F.collect_list(F.struct("start", "begins", "text")))
    together = parts.groupBy("file", "record").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"))
    return rows.unionByName(together.select("file", "text").mapInArrow(mended, schema))

"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators of words: space and the five ASCII controls from tab to carriage return.
SPACE = r"\s+"
#: Bytes of text that a worker takes at a time out of one batch; a longer text is taken alone.
PART = 2_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def plain(df: DataFrame) -> DataFrame:
    """A table with its columns named ``c0``, ``c1`` and so on, so that their own names, in any case, can't clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, column: str) -> str:
    """The name of a column in ``plain``."""
    return f"c{df.columns.index(column)}"


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Some columns under new names."""
    return plain(df).select(*[F.col(place(df, c)).alias(name) for name, c in columns.items()])


def carried(df: DataFrame, **columns: str) -> DataFrame:
    """``_row``, each row as one value, beside some columns under new names; ``uncarried`` undoes it."""
    whole = F.struct(*[F.col(f"c{i}") for i in range(len(df.columns))]).alias("_row")
    return plain(df).select(whole, *[F.col(place(df, c)).alias(name) for name, c in columns.items()])


def uncarried(rows: DataFrame, df: DataFrame) -> DataFrame:
    return rows.select("_row.*").toDF(*df.columns)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def content(df: DataFrame, row: str = "_row") -> Column:
    """A hash of a carried row, but for its maps: an order among rows that agree in all else."""
    return F.xxhash64(F.lit(0), *[F.col(f"{row}.c{i}") for i, f in enumerate(df.schema) if _hashable(f.dataType)])


def map_rows(df: DataFrame, run) -> DataFrame:
    """``mapInArrow`` from and to the columns of a table, whatever their names are."""
    frame = plain(df)
    return frame.mapInArrow(run, frame.schema).toDF(*df.columns)


def parts(batches: Iterable[pa.RecordBatch], at: int, size: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of batches, in order, with about ``size`` bytes of column ``at``, so that what is made of texts isn't made of a whole batch at once.

    When they are used up, or given up, the memory that Arrow keeps for later goes back to the system: workers live on between tasks.
    """
    try:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
                yield batch.slice(low, high - low)
                low = high
    finally:
        pa.default_memory_pool().release_unused()


def words(text: Column) -> Column:
    """The words of a text, in order; none of a null."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), "")

"""Running a span finder over whole texts, and the digests of its spans."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelweave.llm.common import map_rows, take
from parcelweave.shipping import ship

Span = tuple[str, int, int]


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame, finder: Callable[[str], list[Span]], base: tuple[str, ...], order: Callable[[Span], tuple], id_col: str, text_col: str) -> DataFrame:
    """``(id_col, n_<kind> of each base kind, base_sha256, spans)``, one row for each row of ``docs``."""
    ship(docs.sparkSession)
    frame = take(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string"))
    schema = T.StructType([T.StructField(id_col, frame.schema[0].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in base], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    target = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(finder)

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1):
                spans = sorted(sent.value(x.as_py() or ""), key=order)
                own = [s for s in spans if s[0] in base]
                rows.append((*[sum(s[0] == k for s in own) for k in base], hashlib.sha256(written(own).encode()).hexdigest(), written(spans)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(target[0].type), *[pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(target)[1:])]], schema=target)

    return frame.mapInArrow(run, schema)


def redact(docs: DataFrame, finder: Callable[[str], list[Span]], text_col: str) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first and longest names it."""
    ship(docs.sparkSession)
    at, target = docs.columns.index(text_col), to_arrow_schema(docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(finder)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for kind, start, end in sorted(sent.value(text), key=lambda s: (s[1], -s[2])):
            if start >= done:
                out += [text[done:start], f"[{kind}]"]
            done = max(done, end)
        return "".join(out) + text[done:]

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(x.as_py()) for x in columns[at]], target[at].type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], names=batch.schema.names)

    return map_rows(docs, run)

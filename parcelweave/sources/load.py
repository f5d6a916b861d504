"""Reading and writing tables."""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelweave.functions.text import csv_cell
from parcelweave.operators.relational import with_dense_id
from parcelweave.sources.datasets import DATASETS, DatasetSpec
from parcelweave.sources.records import read_records


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def load_csv(spark: SparkSession, path: str, spec: DatasetSpec) -> DataFrame:
    """A CSV file, or a folder of them, with all columns of the dataset, as text.

    Each file's columns are matched by the names of its own header: unknown ones are dropped,
    missing ones are null.  Blank unquoted fields are null, quoted ones are empty; quoted fields may
    hold line breaks, and large files are still read by many tasks.  Without a file the table is
    empty; a header that is empty, names a column of the dataset twice or none at all is an error,
    and so is a row of another length.
    """
    if not _exists(spark, path):
        return empty(spark, spec.schema)
    wanted = list(spec.columns)

    def places(names: list[str], file: str) -> list[int | None]:
        known = [c.strip().lower() for c in names]
        if not any(known):
            raise ValueError(f"{file} has no header")
        if not set(known) & set(wanted):
            raise ValueError(f"{file} has no column of {spec.name}")
        if twice := [c for c in wanted if known.count(c) > 1]:
            raise ValueError(f"{file} names {', '.join(twice)} more than once")
        return [known.index(c) if c in known else None for c in wanted]

    return read_records(spark, path, wanted, places)


def load_dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_csv(spark, f"{folder.rstrip('/')}/{DATASETS[name].file}", DATASETS[name])


def load_positional(spark: SparkSession, path: str | None, columns: Sequence[str]) -> DataFrame:
    """A CSV file whose header is skipped and whose columns go by position, as text; empty without a path."""
    if path is None:
        return empty(spark, T.StructType([T.StructField(c, T.StringType()) for c in columns]))

    def places(names: list[str], file: str) -> list[int | None]:
        if len(names) != len(columns):
            raise ValueError(f"{file} has {len(names)} columns in place of {len(columns)}")
        return list(range(len(names)))

    return read_records(spark, path, list(columns), places)


def point(df: DataFrame, key: str, value) -> DataFrame:
    """Rows by key; row groups are pruned where the table is sorted by it."""
    return df.where(F.col(key) == F.lit(value))


def points(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    return df.where(F.col(key).isin(list(values)))


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The names of a table's versions, the latest last."""
    fs, folder = _files(spark, f"{path}/_versions")
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a table that ``write_table`` wrote."""
    names = _versions(spark, path)
    if not names:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{names[-1]}")


def write_table(df: DataFrame, path: str, sort_by: str | None = None) -> DataFrame:
    """Write a new version of a table, then name it in ``_versions``, so that readers never see a part of one.

    A version is a folder; it counts from the moment that an empty file with its name is created,
    which is one step.  A crash before leaves the version of before, and the one replaced stays for
    readers that have begun; older ones are deleted.
    """
    spark, names = df.sparkSession, _versions(df.sparkSession, path)
    made = f"{int(names[-1].split('-')[0]) + 1 if names else 1:08d}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(sort_by) if sort_by else df).write.parquet(f"{path}/{made}")
    fs, mark = _files(spark, f"{path}/_versions/{made}")
    fs.create(mark, False).close()
    for old in names[:-1]:
        for stale in (f"{path}/_versions/{old}", f"{path}/{old}"):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(stale), True)
    return spark.read.parquet(f"{path}/{made}")


@dataclass(frozen=True)
class BuildFile:
    """What a build needs: datasets, further ones of the service, and the steps before and after the portfolios."""

    dependencies: tuple[str, ...] = ()
    api_dependencies: tuple[str, ...] = ()
    pre: tuple[str, ...] = ()
    post: tuple[str, ...] = ()

    @classmethod
    def read(cls, text: str, pre: str = "wow_pre_sql", post: str = "wow_post_sql") -> BuildFile:
        """From the lists of a YAML file; comments, other keys and ``[]`` are allowed, nesting is not."""
        lists: dict[str, list[str]] = {}
        at = None
        for raw in text.splitlines():
            line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
            if not line or line == "---":
                continue
            if m := re.fullmatch(r"\s*-\s+(.+)", line):
                if at is None:
                    raise ValueError(f"an entry outside a list: {raw}")
                lists[at].append(m[1].strip("'\" "))
            elif m := re.fullmatch(r"(\w+):\s*(?:\[(.*)\])?", line):
                at = m[1]
                lists[at] = [x.strip("'\" ") for x in (m[2] or "").split(",") if x.strip()]
            else:
                raise ValueError(f"no list of names: {raw}")
        names = [tuple(lists.get(k, ())) for k in ("dependencies", "api_dependencies", pre, post)]
        return cls(*names)

    def datasets(self, for_api: bool = False) -> tuple[str, ...]:
        return self.dependencies + (self.api_dependencies if for_api else ())

    def steps(self, which: str = "all") -> tuple[str, ...]:
        return {"pre": self.pre, "post": self.post, "all": self.pre + self.post}[which]

    def build(self, spark: SparkSession, folder: str, builders: dict[str, tuple[str, Sequence[str], Callable[..., DataFrame]]]) -> dict[str, DataFrame]:
        """Load the datasets and run the steps; ``builders`` gives a step its table, inputs and builder, steps without one are passed over."""
        unknown = [d for d in self.dependencies if d not in DATASETS]
        if unknown:
            raise ValueError(f"unknown datasets: {', '.join(unknown)}")
        loaded = {d: load_dataset(spark, folder, d) for d in self.dependencies}
        return build_all(spark, {builders[s][0]: builders[s][1:] for s in self.steps() if s in builders}, loaded)


def build_all(spark: SparkSession, steps: dict[str, tuple[Sequence[str], Callable[..., DataFrame]]], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Build tables in the order of their inputs; ``steps`` names each table's inputs and builder."""
    done, waiting = dict(tables), dict(steps)
    while waiting:
        ready = [name for name, (needs, _) in waiting.items() if set(needs) <= set(done)]
        if not ready:
            raise ValueError(f"inputs missing or circular: {', '.join(sorted(waiting))}")
        for name in ready:
            needs, builder = waiting.pop(name)
            done[name] = builder(*[done[n] for n in needs])
    return done


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def json_parts(df: DataFrame, path: str, *order: str) -> None:
    """All rows as one JSON array in order, as text files that form it one behind the other, by name."""
    rows = with_dense_id(df, [*order], "_nth")
    total = rows.agg(F.max("_nth").alias("_total"))
    said = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    text = F.concat(F.when(F.col("_nth") == 1, "[").otherwise(","), said, F.when(F.col("_nth") == F.col("_total"), "]").otherwise(""))
    rows = rows.crossJoin(F.broadcast(total)).select(text.alias("value"))  # one row
    (df.sparkSession.createDataFrame([("[]",)], "value string") if rows.isEmpty() else rows).write.text(path)


def join_parts(spark: SparkSession, path: str, target: str) -> None:
    """The files of a folder as one file, in the order of their names: joined by the file system where it can, else copied byte by byte."""
    fs, folder = _files(spark, path)
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName())
    files, made = _files(spark, target)
    out = files.create(made, True)
    try:
        if files.getScheme() == "hdfs":  # has concat
            out.close()
            if parts:
                files.concat(made, _array(spark, parts))
            return
        for part in parts:
            own = fs.open(part)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 16, False)
            own.close()
    finally:
        out.close()


def _array(spark: SparkSession, paths: list):
    made = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(paths))
    for i, p in enumerate(paths):
        made[i] = p
    return made


def csv_parts(df: DataFrame, path: str) -> None:
    """Rows as CSV files with a header each: lists joined by commas, null as nothing."""
    cells = [csv_cell(F.col(f"`{f.name}`"), isinstance(f.dataType, T.ArrayType)).alias(f.name) for f in df.schema]
    df.select(*cells).write.options(header=True, escape='"', emptyValue="").csv(path)


def csv_lines(df: DataFrame) -> Iterator[str]:
    """Rows as lines of CSV behind a header, streamed partition by partition: lists joined by commas, null as nothing; no line without rows."""
    cells = [csv_cell(F.col(f"`{f.name}`"), isinstance(f.dataType, T.ArrayType)).alias(f.name) for f in df.schema]
    def line(values) -> str:
        out = io.StringIO()
        csv.writer(out).writerow(values)
        return out.getvalue()

    for i, row in enumerate(df.select(*cells).toLocalIterator()):
        if i == 0:
            yield line(df.columns)
        yield line(row)


def result_lines(df: DataFrame, name: str = "result", **more: str) -> Iterator[str]:
    """The rows as one JSON object ``{name: [...]}``, streamed partition by partition; ``more`` goes before them."""
    yield "{" + "".join(f"{json.dumps(k)}: {v}, " for k, v in more.items()) + f"{json.dumps(name)}: ["
    for i, (line,) in enumerate(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()):
        yield (", " if i else "") + line
    yield "]}"

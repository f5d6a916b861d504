"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder will do for a local master, as in tests; on a
    cluster its machines could not see each other's, so that this is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parcelweave-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives the loss of any executor.

    Its files go when nothing refers to it any more, if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``session`` sets it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """The tables that ``materialize`` writes meanwhile."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, so that later passes prune columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._folder = path
    for own in _SCOPES:
        own.append(made)
    return made


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, when no later plan reads it."""
    for table in tables:
        context = table.sparkSession.sparkContext
        folder = shared_dir(table.sparkSession).rstrip("/")
        named = table.__dict__.get("_folder")
        for path in [context._jvm.org.apache.hadoop.fs.Path(named)] if named else [context._jvm.org.apache.hadoop.fs.Path(f).getParent() for f in table.inputFiles()]:
            if path.getParent().toString().rstrip("/").split(":")[-1].lstrip("/") == folder.split(":")[-1].lstrip("/"):
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
                break

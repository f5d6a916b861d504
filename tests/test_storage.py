import os

import pytest
from pyspark.sql import functions as F

from parcelweave import storage


def test_discard_deletes_only_what_was_materialized(spark, frame, tmp_path):
    own = storage.materialize(frame("a int", (1,), (2,)), "own")
    folder = os.path.dirname(own.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
    assert os.path.dirname(folder) == storage.shared_dir(spark).removeprefix("file:").rstrip("/")
    frame("a int", (1,)).write.parquet(str(tmp_path / "other"))
    storage.discard(own.select((F.col("a") + 1).alias("b")), spark.read.parquet(str(tmp_path / "other")))
    assert not os.path.exists(folder) and spark.read.parquet(str(tmp_path / "other")).count() == 1


def test_scope_names_what_was_written(spark, frame):
    with storage.scope() as outer:
        first = storage.materialize(frame("a int"), "empty")
        with storage.scope() as inner:
            second = storage.materialize(first, "again")
    later = storage.materialize(frame("a int", (1,)), "later")
    assert outer == [first, second] and inner == [second]
    folders = [t._folder.removeprefix("file:") for t in (first, second, later)]
    storage.discard(*outer)
    assert [os.path.exists(f) for f in folders] == [False, False, True] and later.count() == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())

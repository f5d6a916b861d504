"""Getting this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "_parcelweave_shipped"


def many_tasks(spark: SparkSession) -> int:
    """Tasks for a costly step on few small rows, which adaptive execution would leave to one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def ship(spark: SparkSession) -> None:
    """Send the package to all executors through Spark's own file server, once for each application.

    Workers import it by name, wherever they run and whatever their working directory is.
    """
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="parcelweave-"), "parcelweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.join("parcelweave", os.path.relpath(full, here)))
    context.addPyFile(path)
    setattr(context, _SHIPPED, True)

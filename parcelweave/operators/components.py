"""Connected components by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelweave.shipping import ship
from parcelweave.storage import cut

#: Edges that a task of ``spanning`` holds at a time.
AT_A_TIME = 1 << 20


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that occurs in ``edges``; the component is its smallest node.

    Each round first joins every node's larger neighbours to the smallest node of its
    neighbourhood, then does the same for its smaller neighbours.  Minima are aggregated with
    a map-side combine and joined back, so that a hub's neighbours are never gathered in a list.
    Edges with a null end and self loops are ignored, except that a self loop still names its node.
    """
    pairs = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    loops = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    links = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = links.union(links.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        links = cut(small)
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select("component").distinct().select(F.col("component").alias("node"), F.col("component"))
    lone = loops.join(found.select("node").union(roots.select("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(roots).union(lone)


def _lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, and the smallest node that each reaches."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        x, y = low[x], low[y]
        apart = x != y
        if not apart.any():
            return names, names[low]
        x, y = x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def spanning(edges: DataFrame) -> DataFrame:
    """``(src, dst)``: links with the same components as ``edges`` of whole numbers, at most one for a node and ``AT_A_TIME`` rows.

    Rows next to each other become links to the smallest node that is reached within them, where they stand.
    """
    ship(edges.sparkSession)

    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, low = _lowest(*[np.concatenate([part.column(k).to_numpy() for part in held]) for k in (0, 1)])
        return pa.RecordBatch.from_arrays([pa.array(x[nodes != low]) for x in (nodes, low)], ["src", "dst"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in parts:
            held.append(part)
            n += part.num_rows
            if n >= AT_A_TIME:
                yield linked(held)
                held, n = [], 0
        if n:
            yield linked(held)

    ends = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return ends.where("src IS NOT NULL AND dst IS NOT NULL").mapInArrow(run, "src long, dst long")

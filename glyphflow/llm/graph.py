"""Connected components as DataFrame steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.plans.staging import Workspace, one_partition


def joined(edges: pa.Table) -> pa.Table:
    """(id, component) of edges in memory."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in zip(*(c.to_pylist() for c in edges.columns)):
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    ids = list(up)
    return pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(map(top, ids), pa.int64(), size=len(ids))})


def components(ws: Workspace, edges: DataFrame, here: int = 0) -> DataFrame:
    """Returns (id, component): the smallest id reachable, for each id with an edge.

    edges: (a, b), in either direction, repeats and loops allowed. Each round takes the
    smallest label among a vertex and its neighbours (a partial aggregate, so a hub does
    not meet in one task), then follows labels one step (pointer jumping), which needs
    about log2 of the longest path rounds. Joins are plain equi-joins of staged tables,
    so that adaptive execution splits a hub's partition; where the edges are counted as few,
    they are one partition and nothing is shuffled. An empty table gives no rows.

    Up to ``here`` edges, by their count, are put together in the driver instead (16 bytes
    each): the rounds are many small jobs.
    """
    if here and edges.count() <= here:
        return ws.spark.createDataFrame(joined(edges.select("a", "b").toArrow())).coalesce(1)
    both = one_partition(ws.keep(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct()))
    label = one_partition(ws.keep(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component"))))
    while True:
        near = both.join(label, F.col("v") == F.col("id")).groupBy("u").agg(F.min("component").alias("best"))
        step = one_partition(ws.keep(label.join(near, F.col("id") == F.col("u")).select("id", F.col("component").alias("old"), F.least("component", "best").alias("component"))))
        jump = step.select(F.col("id").alias("to"), F.col("component").alias("further"))
        new = one_partition(ws.keep(step.join(jump, F.col("component") == F.col("to"), "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component"))))
        ws.drop(step, label)
        done = new.where("old <> component").limit(1).count() == 0
        label = new
        if done:
            ws.drop(both)
            return label.select("id", "component")

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import arrow_map, settle

#: Edge tables of at most so many rows, which is checked, are put together in one executor task.
ONE_TASK = 200_000


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One round: each node tells neighbours the least node it sees (large: those above it; small: those below)."""
    both = edges.select("a", "b") if small else edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    seen = both.join(least, "a")
    if small:  # what lies below a hangs on the least of it, and so does a
        out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return settle(out.where("a <> b").distinct(), "stars")


def _join_up(batches):
    """Components by union and find; the least node is the root."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    kind = None
    for b in batches:
        kind = b.schema.field("a").type
        for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["id", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for each node of edges (a, b), settled; component is the least node that can be reached.

    Loops and repeated edges do no harm; an empty table gives an empty one. Up to one_task edges are joined in
    one task of an executor; more in rounds that grow with the logarithm of the longest path. Only a count and
    a checksum of the edges come to the driver.
    """
    if edges.limit(one_task + 1).count() <= one_task:
        kind = dict(edges.dtypes)["a"]
        return settle(arrow_map(edges.select("a", "b").coalesce(1), _join_up, f"id {kind}, component {kind}"), "components")
    edges = settle(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == mark or not now[0]:
            return settle(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct(), "components")
        mark = now
        edges = _stars(_stars(edges, small=False), small=True)

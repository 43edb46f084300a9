"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelark.functions.storage import write_through
from framelark.llm.lean import lean_map

PAIR = "a bigint, b bigint"


def _spanning(batches):
    """Replace the edges of a task by a spanning forest (each node to its smallest)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield _forest(parent, find)
            parent.clear()
    if parent:
        yield _forest(parent, find)


def _forest(parent, find):
    nodes = [x for x in parent if parent[x] != x]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array([find(x) for x in nodes], np.int64)), pa.array(np.array(nodes, np.int64))], names=["a", "b"]
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges(a, b)``; component = smallest node.

    Each task first reduces its own edges to a spanning forest. Then rounds of
    large-star and small-star run until nothing changes; every round is a written
    table, so lost executors cost one round at most. Loops and nulls are ignored.
    """
    work = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    work = write_through(work.mapInArrow(lean_map(_spanning), PAIR).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # Every node's neighbours above it move to its smallest neighbour.
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = write_through(low, "least")
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # Then every node's smaller neighbours, and itself, move to the smallest of them.
        large = write_through(large, "large")
        floor = write_through(large.groupBy("b").agg(F.min("a").alias("m")), "floor")
        small = (
            large.join(floor, "b")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e"))
            .select("e.a", "e.b")
            .filter("a < b")
            .distinct()
        )
        work = write_through(small, "small")
        mark = tuple(
            work.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        )
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    nodes = work.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.union(work.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

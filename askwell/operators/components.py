"""Connected components of an edge list.

Every node ends with the least node of its component.  Edges are first contracted
within each partition (union-find over the partition's own edges), then two steps
alternate until nothing changes: the *large star* ties each node's greater
neighbours to the least node around it, the *small star* its lesser ones.  Both
keep components whole and shorten a chain of n links to a star in about log n
rounds.  A round is two aggregations and joins over the edges; what a round wrote
is deleted once the next one stands.  As soon as no more than ``ONE_TASK`` edges
are left, one task contracts them: the same components without further rounds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.session import remove, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: edges that one task contracts at most
ONE_TASK = 200_000


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v), v < u: each partition's edges as stars around least nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            parent.setdefault(x, x)
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = root(x), root(y)
                if a != c:
                    parent[max(a, c)] = min(a, c)
        nodes = [n for n in parent if root(n) != n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(nodes, np.int64)), pa.array(np.array([root(n) for n in nodes], np.int64))], ["u", "v"]
        )

    return edges.mapInArrow(run, "u long, v long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "_u")
    tied = both.join(least, F.col("u") == F.col("_u")).filter(F.col("v") > F.col("u"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
    tied = e.join(least, F.col("u") == F.col("_u")).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()


def components(
    edges: DataFrame, src: str = "src", dst: str = "dst", *, rounds: list | None = None, one_task: int = ONE_TASK
) -> DataFrame:
    """(node, component) of all nodes that stand in an edge to another one.

    ``rounds``, if given, receives the number of rounds."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u <> v")
    e, path = stored(_contracted(pairs), "component-edges")
    state, done = None, 0
    while True:
        # count and hash stand for the set of edges, whatever its order
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        last = now[0] <= one_task
        step, next_path = stored(_contracted(e.coalesce(1)) if last else _small_star(_large_star(e)), "component-edges")
        remove(spark, path)
        e, path, state = step, next_path, now
        if last:
            break
        done += 1
    if rounds is not None:
        rounds.append(done)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

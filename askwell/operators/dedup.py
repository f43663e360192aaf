"""V6 greedy dedup: process candidates in arrival order; a candidate is kept
iff no earlier *kept* candidate is within the threshold.

Whether a node is kept depends on its connected component alone.  So components
are found first (``components``); each one with at most ``COMPONENT_EDGES`` edges
is settled by one task in arrival order, however long its chains are, and many
such components share a task.  Only larger components take rounds:
  keep  = undecided nodes with no earlier neighbour that is undecided or kept
  drop  = undecided nodes with an earlier neighbour that is kept
Each round decides at least the earliest undecided node of each component and
equals the sequential loop (a node is kept iff no kept earlier neighbour exists).
State is written every round, so a lost executor only repeats the present one.
"""

from __future__ import annotations

import itertools
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.operators.components import components
from askwell.session import materialize, remove, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT, DROPPED, UNDECIDED = "kept", "dropped", "undecided"
#: edges of a component that one task settles at most
COMPONENT_EDGES = 200_000


def greedy_dedup(nodes: DataFrame, edges: DataFrame, *, id_col: str = "id", component_edges: int = COMPONENT_EDGES) -> DataFrame:
    """``nodes``: (id_col); ``edges``: (src, dst) with src before dst in the
    arrival order, which is the order of the ids.

    Returns (id_col, kept boolean, round): round 0 for nodes without an edge, 1
    for components settled by one task, else the round that decided."""
    ids = nodes.select(F.col(id_col).cast("long").alias("id")).distinct()
    known = ids.select(F.col("id").alias("k"))
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    e = e.join(known, F.col("src") == F.col("k"), "left_semi").join(known, F.col("dst") == F.col("k"), "left_semi")
    e = materialize(e, "greedy-edges")
    member = materialize(components(e), "greedy-components")
    sized = materialize(
        e.join(member, F.col("src") == F.col("node")).select("src", "dst", "component"), "greedy-sized"
    )
    sizes = sized.groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    large = sizes.filter(F.col("edges") > component_edges).select("component")
    small = sized.join(large, "component", "left_anti")
    decided = small.groupBy("component").applyInArrow(_settle, "id long, kept boolean").withColumn("round", F.lit(1))
    if not large.isEmpty():
        decided = decided.unionByName(_in_rounds(sized.join(large, "component", "left_semi").select("src", "dst")))
    decided = decided.select(F.col("id").alias("_id"), "kept", "round")
    return ids.join(decided, F.col("id") == F.col("_id"), "left").select(
        F.col("id").alias(id_col), F.coalesce("kept", F.lit(True)).alias("kept"), F.coalesce("round", F.lit(0)).cast("int").alias("round")
    )


def _settle(edges: pa.Table) -> pa.Table:
    """One component, in arrival order: a node is dropped by a kept earlier one."""
    earlier: dict[int, list[int]] = {}
    for a, b in zip(edges.column("src").to_pylist(), edges.column("dst").to_pylist(), strict=True):
        earlier.setdefault(a, [])
        earlier.setdefault(b, []).append(a)
    kept: dict[int, bool] = {}
    for n in sorted(earlier):
        kept[n] = not any(kept.get(m, False) for m in earlier[n])
    return pa.table({"id": pa.array(kept.keys(), pa.int64()), "kept": pa.array(kept.values(), pa.bool_())})


def _in_rounds(edges: DataFrame) -> DataFrame:
    """(id, kept, round) of all nodes of ``edges``, round by round."""
    spark = edges.sparkSession
    e, e_path = stored(edges, "round-edges")
    both = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id"))).distinct()
    has_earlier = e.select(F.col("dst").alias("id")).distinct().withColumn("c", F.lit(True))
    state, path = stored(
        both.join(has_earlier, "id", "left").select(
            "id",
            F.when(F.col("c"), F.lit(UNDECIDED)).otherwise(F.lit(KEPT)).alias("status"),
            F.when(F.col("c"), F.lit(None)).otherwise(F.lit(1)).cast("int").alias("round"),
        ),
        "round-state",
    )
    for rnd in itertools.count(2):
        undecided = state.filter(F.col("status") == UNDECIDED).select("id")
        if undecided.isEmpty():
            break
        status = state.select(F.col("id").alias("src"), F.col("status").alias("s_status"))
        # of the edges into undecided nodes: what their earlier ends came to
        met = (
            e.join(undecided.select(F.col("id").alias("dst")), "dst", "left_semi").join(status, "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.max(F.col("s_status") == KEPT).alias("dropped"), F.max(F.col("s_status") == UNDECIDED).alias("waits"))
        )
        # an undecided node with a kept earlier neighbour goes, one whose earlier neighbours all went stays
        verdict = F.when(F.col("dropped"), F.lit(DROPPED)).when(~F.col("waits"), F.lit(KEPT))
        after = state.join(met, "id", "left").select(
            "id",
            F.when(F.col("status") == UNDECIDED, F.coalesce(verdict, F.lit(UNDECIDED))).otherwise(F.col("status")).alias("status"),
            F.when((F.col("status") == UNDECIDED) & verdict.isNotNull(), F.lit(rnd)).otherwise(F.col("round")).alias("round"),
        )
        state, next_path = stored(after, "round-state")
        remove(spark, path)
        path = next_path
    remove(spark, e_path)
    return state.select("id", (F.col("status") == KEPT).alias("kept"), "round")

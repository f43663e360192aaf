"""Global ranking and top-n without a single-partition window.

``RANK() OVER (ORDER BY x DESC)`` with no PARTITION BY makes Spark move every
row into one task.  Here the rows are range-partitioned on the sort key (equal
keys always land in the same range), ranked locally, and shifted by the number
of rows in all earlier ranges.  Only one row per partition is gathered, so the
work stays spread over the cluster whatever the row count.

A range split samples its borders anew each time it is evaluated, so the locally
ranked rows are written once and both the rows and the ranges' sizes are read
from that one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwell.session import materialize


def global_rank(
    df: DataFrame,
    order: list[Column],
    rank_col: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``rank_col`` = RANK() over ``order`` for the whole DataFrame."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_rpid", F.spark_partition_id())
    local = materialize(
        ranged.withColumn("_rlocal", F.rank().over(Window.partitionBy("_rpid").orderBy(*order))), "rank"
    )
    sizes = local.groupBy("_rpid").agg(F.count(F.lit(1)).alias("_rn"))
    # one row per partition: the running count is over at most n rows
    offsets = sizes.select(
        "_rpid",
        F.coalesce(
            F.sum("_rn").over(
                Window.orderBy("_rpid").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_roff"),
    )
    return (
        local.join(F.broadcast(offsets), "_rpid")
        .withColumn(rank_col, (F.col("_rlocal") + F.col("_roff")).cast("bigint"))
        .drop("_rpid", "_rlocal", "_roff")
    )


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """ORDER BY .. LIMIT n: Spark plans TakeOrderedAndProject, a per-partition
    top-n followed by a merge of n rows per partition."""
    return df.orderBy(*order).limit(n)


def global_prefix_sums(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[str],
    value_cols: list[str],
    num_partitions: int | None = None,
) -> DataFrame:
    """Running position ``_i`` (1-based) and running sums ``{v}_cum`` within
    each group in ``order_cols`` order, without putting a group in one task:
    rows are range-partitioned on (group, order), summed locally, and shifted
    by the totals of the same group in earlier partitions (one row per
    partition and group).  ``order_cols`` should be unique within a group."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols + order_cols]
    ranged = df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
    w_local = (
        Window.partitionBy("_pid", *group_cols)
        .orderBy(*order_cols)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumn("_li", F.count(F.lit(1)).over(w_local))
    for v in value_cols:
        local = local.withColumn(f"_l_{v}", F.sum(v).over(w_local))
    local = materialize(local, "prefix-sums")
    totals = local.groupBy("_pid", *group_cols).agg(
        F.count(F.lit(1)).alias("_pn"), *[F.sum(v).alias(f"_pt_{v}") for v in value_cols]
    )
    w_off = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *group_cols,
        F.coalesce(F.sum("_pn").over(w_off), F.lit(0)).alias("_oi"),
        *[F.coalesce(F.sum(f"_pt_{v}").over(w_off), F.lit(0)).alias(f"_o_{v}") for v in value_cols],
    )
    out = local.join(offsets, ["_pid", *group_cols]).withColumn("_i", F.col("_li") + F.col("_oi"))
    for v in value_cols:
        out = out.withColumn(f"{v}_cum", F.col(f"_l_{v}") + F.col(f"_o_{v}"))
    drop = ["_pid", "_li", "_oi"] + [f"_l_{v}" for v in value_cols] + [f"_o_{v}" for v in value_cols]
    return out.drop(*drop)

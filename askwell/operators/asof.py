"""Forward as-of join: for each left row, the earliest right row of the same
key at or after it, within a horizon.  Spark has no as-of join; this one is
exact and never pairs rows.

  1. Time is cut into buckets of ``bucket_seconds``.
  2. Same bucket: left and right rows of one (key, bucket) are unioned and
     ordered by (ts, side); the earliest right row at or after each left row is
     a running min over the following rows.  A hot key is split by bucket,
     and the work per bucket is a sort, not a pairing.
  3. Later buckets: right rows are first reduced to one row per (key, bucket)
     (partial aggregation), and for each bucket the earliest right row of any
     later bucket is a running min over those per-bucket rows — at most one
     row per active bucket of the key, whatever the raw row count.
  4. The answer is the smaller of the two; rows past the horizon are dropped
     (the earliest candidate is past it, so every candidate is).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bucket(ts_col: str, seconds: int):
    return F.floor(F.unix_micros(F.col(ts_col).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def first_at_or_after(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    left_id: str,
    left_ts: str,
    right_id: str,
    right_ts: str,
    right_value: str,
    horizon_seconds: int,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Returns (left_id, key, left_ts, right_id, right_ts, right_value) for the
    left rows that have a right row with left_ts <= right_ts <= left_ts + horizon;
    ties on right_ts go to the smaller right_id."""
    L = left.select(
        F.col(key).alias("k"), F.col(left_id).alias("lid"), F.col(left_ts).alias("lts"),
    ).withColumn("b", _bucket("lts", bucket_seconds))
    R = right.select(
        F.col(key).alias("k"), F.col(right_id).alias("rid"), F.col(right_ts).alias("rts"),
        F.col(right_value).alias("rval"),
    ).withColumn("b", _bucket("rts", bucket_seconds))
    rstruct = F.struct(F.col("rts"), F.col("rid"), F.col("rval"))
    rtype = R.select(rstruct.alias("r")).schema["r"].dataType.simpleString()

    # 2) same bucket: union + running min over following rows
    both = L.select("k", "b", F.col("lts").alias("ts"), F.lit(0).alias("side"), "lid",
                    F.lit(None).cast(rtype).alias("r"))
    both = both.unionByName(
        R.select("k", "b", F.col("rts").alias("ts"), F.lit(1).alias("side"),
                 F.lit(None).cast(L.schema["lid"].dataType).alias("lid"), rstruct.alias("r"))
    )
    w_same = (
        Window.partitionBy("k", "b")
        .orderBy("ts", "side")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    same = both.withColumn("same_r", F.min("r").over(w_same)).filter(F.col("side") == 0).select(
        "k", "b", "lid", F.col("ts").alias("lts"), "same_r"
    )

    # 3) later buckets: one row per (key, bucket) on the right side
    per_bucket = R.groupBy("k", "b").agg(F.min(rstruct).alias("bmin"))
    left_buckets = L.select("k", "b").distinct().withColumn("bmin", F.lit(None).cast(rtype))
    w_later = Window.partitionBy("k").orderBy(F.desc("b")).rangeBetween(Window.unboundedPreceding, -1)
    later = (
        per_bucket.unionByName(left_buckets)
        .withColumn("later_r", F.min("bmin").over(w_later))
        .groupBy("k", "b")
        .agg(F.min("later_r").alias("later_r"))
    )

    # 4) combine and apply the horizon
    j = same.join(later, ["k", "b"], "left")
    best = F.least(F.col("same_r"), F.col("later_r"))
    out = j.withColumn("best", best).filter(
        F.col("best").isNotNull()
        & (F.col("best.rts") <= F.col("lts") + F.expr(f"INTERVAL {horizon_seconds} SECONDS"))
    )
    return out.select(
        F.col("lid").alias(left_id),
        F.col("k").alias(key),
        F.col("lts").alias(left_ts),
        F.col("best.rid").alias(right_id),
        F.col("best.rts").alias(right_ts),
        F.col("best.rval").alias(right_value),
    )

"""Ranks and running sums over range partitions, with columns besides the key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from askwell.operators.ranking import global_prefix_sums, global_rank


@pytest.mark.parametrize("parts", [3, 16])
def test_global_rank_many_rows_other_columns(spark, parts):
    df = spark.range(60_000).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(40_000)).alias("v"), F.md5(F.col("id").cast("string")).alias("other")
    )
    got = global_rank(df, [F.col("v").desc()], "rank", num_partitions=parts)
    assert "Exchange rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.select("id", "v", "rank").toPandas()
    want = rows["v"].rank(method="min", ascending=False).astype("int64")
    assert len(rows) == 60_000 and (rows["rank"] == want).all()


def test_global_prefix_sums_many_rows(spark):
    df = spark.range(50_000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("v"), F.lit("x").alias("other"))
    rows = global_prefix_sums(df, ["g"], ["id"], ["v"], num_partitions=9).toPandas().sort_values(["g", "id"])
    assert (rows["_i"] == rows.groupby("g").cumcount() + 1).all()
    assert (rows["v_cum"] == rows.groupby("g")["v"].cumsum()).all()


def test_rank_of_empty_table(spark):
    assert global_rank(spark.range(0), [F.col("id")], "rank", num_partitions=4).count() == 0

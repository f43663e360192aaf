"""Vector memory search: V0 embed, V1/V2 exact top-k, V3 LSH, V4 max
similarity, V5 dedup gate, and the threshold edge list used by V6.

Exact search is the block join of ``metric_join``: rows lie in blocks around
reference points, and pairs of blocks that the triangle inequality rules out
(against the threshold, or against a query's k-th best so far) are never formed.
Ranking ties are broken by (similarity rounded to 6 dp desc, store id asc) in
both Spark and the oracle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askwell.operators import metric_join
from askwell.operators.metric_join import SIM_DIGITS
from askwell.session import materialize


def _signed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return materialize(metric_join.vector_signatures(df, id_col, vec_col), "vectors")


def topk_neighbors(
    queries: DataFrame,
    store: DataFrame,
    k: int = 3,
    *,
    q_id: str = "id",
    q_vec: str = "embedding",
    s_id: str = "id",
    s_vec: str = "embedding",
    exclude_self: bool = False,
    only_earlier: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """The k most similar store rows per query.

    Returns (q_id, rank, s_id, similarity) with similarity rounded to 6 dp.
    ``block_rows`` is the aimed size of a block (default: by the size of the store).
    """
    s = _signed(store, s_id, s_vec)
    q = s if queries is store and (q_id, q_vec) == (s_id, s_vec) else _signed(queries, q_id, q_vec)
    found = metric_join.topk_join(q, s, k, exclude_self=exclude_self, only_earlier=only_earlier, block_rows=block_rows)
    return metric_join.ranked(found, k)


def similarity_edges(
    df: DataFrame,
    threshold: float,
    *,
    id_col: str = "id",
    vec_col: str = "embedding",
    block_rows: int | None = None,
) -> DataFrame:
    """Pairs (src earlier, dst later) with rounded similarity >= threshold."""
    edges = metric_join.threshold_join(_signed(df, id_col, vec_col), None, threshold, block_rows=block_rows)
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity")


def max_similarity(
    queries: DataFrame,
    store: DataFrame,
    *,
    q_id: str = "id",
    q_vec: str = "embedding",
    s_id: str = "id",
    s_vec: str = "embedding",
    only_earlier: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """V4: best similarity of each query to the store; 0.0 when the store (or
    the earlier part of it) is empty.  Returns (q_id, nearest_id, max_similarity)."""
    best = topk_neighbors(
        queries, store, 1, q_id=q_id, q_vec=q_vec, s_id=s_id, s_vec=s_vec,
        only_earlier=only_earlier, block_rows=block_rows,
    )
    base = queries.select(F.col(q_id).cast("bigint").alias("q_id"))
    return base.join(best, "q_id", "left").select(
        "q_id",
        F.col("s_id").alias("nearest_id"),
        F.coalesce(F.col("similarity"), F.lit(0.0)).alias("max_similarity"),
    )


def dedup_gate(
    candidates: DataFrame,
    store: DataFrame,
    threshold: float = 0.95,
    **kw,
) -> DataFrame:
    """V5: a candidate is a duplicate iff its max similarity to the store is
    >= threshold (similarity, not distance — decision D1)."""
    m = max_similarity(candidates, store, **kw)
    return m.withColumn("is_duplicate", F.col("max_similarity") >= F.lit(threshold))


def embed_text(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 1024) -> DataFrame:
    """V0 default embedder: terms -> hashed term counts -> unit L2 vector,
    all pyspark.ml stages (JVM side); output array<double>."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    from askwell.functions.text import TERM_PATTERN

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TERM_PATTERN, gaps=False)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    norm = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)
    out = norm.transform(tf.transform(tok.transform(df)))
    return out.withColumn(out_col, vector_to_array("_unit")).drop("_tok", "_tf", "_unit")


def lsh_pairs(
    df: DataFrame,
    threshold: float,
    *,
    id_col: str = "id",
    vec_col: str = "embedding",
    bucket_length: float = 0.5,
    num_tables: int = 16,
    seed: int = 42,
) -> DataFrame:
    """V3: approximate pairs with cosine >= threshold via random-projection
    LSH on unit vectors (Euclidean distance sqrt(2 - 2 cos)).  Candidate pairs
    share a hash bucket in some table; their exact cosine is then checked, so
    output pairs are a subset (recall < 1 possible) of the exact edges.  Buckets
    may hold most rows: ``metric_join.bucket_join`` multiplies units of rows
    instead of joining each bucket with itself.  Null vectors are left out."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    unit = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vec_col).cast("array<double>").alias("v"),
    ).filter(F.col("v").isNotNull())
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
    unit = unit.withColumn("v", F.transform("v", lambda x: x / norm)).withColumn(
        "features", array_to_vector("v")
    )
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length,
        numHashTables=num_tables, seed=seed,
    ).fit(unit)
    buckets = F.array(*[vector_to_array(F.col("hashes")[k])[0].cast("long") for k in range(num_tables)])
    rows = model.transform(unit).select("id", "v", buckets.alias("buckets")).distinct()
    pairs = metric_join.bucket_join(materialize(rows, "lsh-rows"), threshold)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity")

"""Feedback loop as bulk DataFrame operations: traces x human scores ->
positive filter -> completeness -> validation gate -> dedup gate -> append.

The reference walks traces one at a time (one request per trace for its
scores) and each accepted trace is visible to the next.  Here a whole batch
is one plan: scores are reduced to the first qualifying score per trace by
aggregation (no trace x score pairing), the gates are column expressions, and
the order-dependent dedup is the exact greedy rounds of ``dedup.greedy_dedup``.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.session import ensure_checkpoint_dir, materialize, scratch_path
from askwell.functions.sql_scan import validate_texts
from askwell.functions.text import (
    REASON_EMPTY,
    REASON_WRITE,
    has_write_keyword,
    is_blank,
)

# ---------------------------------------------------------------------------
# Fixed values (defaults of the reference):
#   score name "quality", positive threshold 1.0, 
#   look-back 7 days, poll interval 60 s
#   messages of a manual addition: ADDED, DUPLICATE, and FAILED before the reason
# ---------------------------------------------------------------------------
SCORE_NAME = "quality"
POSITIVE_THRESHOLD = 1.0
TRACE_TAG = "question-answering"  # a neutral default; callers name their own
LOOKBACK = dt.timedelta(days=7)
POLL_SECONDS = 60
ADDED = "Example added to behavioral memory."
DUPLICATE = "Example too similar to existing entry (duplicate)."
FAILED = "Validation failed: "

APPROVED, REJ_VALID, REJ_DUP, SKIPPED = "approved", "rejected_validation", "rejected_duplicate", "skipped"

TRACE_SCHEMA = (
    "trace_id string, ts timestamp, tags array<string>, user_id string, session_id string, input string, "
    "metadata struct<question:string, generated_sql:string, sql_valid:boolean, sql_error:string, "
    "tables_used:array<string>, few_shot_count:int, row_count:int>"
)
SCORE_SCHEMA = "trace_id string, ts timestamp, name string, value double, comment string"


# --- S8 / S10 / S11 -----------------------------------------------------------------


def read_traces(
    traces: DataFrame,
    *,
    tag: str = TRACE_TAG,
    since: dt.datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Traces with ``tag``, at or after ``since`` (applied, D6), newest
    first; all of them unless the caller sets ``limit`` (a per-poll cap)."""
    t = traces.filter(F.array_contains("tags", tag))
    if since is not None:
        t = t.filter(F.col("ts") >= F.lit(since))
    t = t.orderBy(F.desc("ts"), F.desc("trace_id"))
    return t.limit(limit) if limit is not None else t


def traces_from_predictions(predictions: DataFrame, tag: str = TRACE_TAG) -> DataFrame:
    """One trace per prediction (question, SQL, validity, error, example
    count, row count) in the T4 layout."""
    return predictions.select(
        F.col("trace_id").cast("string"),
        F.col("created_at").cast("timestamp").alias("ts"),
        F.array(F.lit(tag)).alias("tags"),
        F.lit(None).cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("session_id"),
        F.col("question").alias("input"),
        F.struct(
            F.col("question"),
            F.col("generated_sql"),
            F.col("sql_valid"),
            F.col("sql_error"),
            F.coalesce(F.col("tables_used"), F.array().cast("array<string>")).alias("tables_used"),
            F.size(F.coalesce(F.col("examples_used"), F.array())).cast("int").alias("few_shot_count"),
            F.col("row_count").cast("int"),
        ).alias("metadata"),
    )


def score_rows(df: DataFrame, *, name: str = SCORE_NAME, value: float = 1.0, comment: str = "") -> DataFrame:
    """A score per trace id in ``df`` (defaults: quality, 1.0, '')."""
    return df.select(
        F.col("trace_id").cast("string"),
        F.current_timestamp().alias("ts"),
        F.lit(name).alias("name"),
        F.lit(value).cast("double").alias("value"),
        F.lit(comment).alias("comment"),
    )


# --- F3 / J6 / W5 ---------------------------------------------------------------------


def positive_scores(scores: DataFrame, *, name: str = SCORE_NAME, threshold: float = POSITIVE_THRESHOLD) -> Column:
    """F3 predicate: right name, value present and >= threshold."""
    return (F.col("name") == name) & F.col("value").isNotNull() & (F.col("value") >= threshold)


def first_positive(
    traces: DataFrame,
    scores: DataFrame,
    *,
    name: str = SCORE_NAME,
    threshold: float = POSITIVE_THRESHOLD,
) -> DataFrame:
    """One record per trace with a qualifying score — the first by
    (score ts, value, comment).  Scores are reduced per trace by aggregation
    (map-side partial min), so a trace with very many scores is one row
    before the join.  question = metadata.question if present, else input."""
    s = scores.filter(positive_scores(scores, name=name, threshold=threshold))
    first = s.groupBy("trace_id").agg(
        F.min(F.struct("ts", "value", F.coalesce("comment", F.lit("")).alias("comment"))).alias("s")
    )
    q = F.when(F.col("metadata.question").isNotNull(), F.col("metadata.question")).otherwise(
        F.coalesce(F.col("input"), F.lit(""))
    )
    return traces.join(first, "trace_id").select(
        "trace_id",
        "ts",
        q.alias("question"),
        F.coalesce(F.col("metadata.generated_sql"), F.lit("")).alias("generated_sql"),
        F.col("s.value").alias("score_value"),
        F.col("s.comment").alias("score_comment"),
        F.col("s.ts").alias("score_ts"),
    )


# --- F4 / E9 -------------------------------------------------------------------------------


def validation_reason(sql: Column, analysable: Column | None = None) -> Column:
    """E9 column: NULL when valid, else the first failing check's reason
    (not empty -> no write keyword -> analysable)."""
    r = F.when(is_blank(sql), F.lit(REASON_EMPTY)).when(has_write_keyword(sql), F.lit(REASON_WRITE))
    if analysable is not None:
        r = r.when(~analysable, F.lit("EXPLAIN failed"))
    return r


def analysable_texts(spark: SparkSession, texts: DataFrame, col: str = "generated_sql", chunk: int = 5_000) -> DataFrame:
    """Which distinct SQL texts Spark can analyse (``spark.sql(q).schema``
    raises on unknown tables/columns).  Analysis is the driver's own work, so
    only the *distinct* texts that passed the cheap checks reach it, one
    partition at a time, and outcomes are written away every ``chunk`` texts:
    the driver holds no more than that, however many there are."""
    distinct = materialize(
        texts.select(col).distinct().filter(~is_blank(F.col(col)) & ~has_write_keyword(F.col(col))), "sql-texts"
    )
    path = scratch_path(spark, f"analysed-{uuid.uuid4().hex}")
    schema = f"{col} string, analysable boolean"
    out: list[tuple[str, bool]] = []
    spark.createDataFrame([], schema).write.parquet(path)
    for row in distinct.toLocalIterator():
        q = row[col]
        try:
            spark.sql(q).schema  # analysis only: SELECT is not executed
            ok = True
        except Exception:
            ok = False
        out.append((q, ok))
        if len(out) == chunk:
            spark.createDataFrame(out, schema).write.mode("append").parquet(path)
            out = []
    if out:
        spark.createDataFrame(out, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


# --- ST1 -----------------------------------------------------------------------------------


def gate_candidates(
    positives: DataFrame,
    *,
    analysable: DataFrame | None = None,
    catalogue: DataFrame | None = None,
) -> DataFrame:
    """F4 + E9 on the positive traces: adds ``status`` (skipped /
    rejected_validation / NULL = still a candidate) and ``reason``.  With
    ``catalogue`` (table_name) the texts are scanned by Spark; ``analysable`` holds
    the driver's own analysis of a bounded set of texts."""
    df = positives
    scanned = None
    if catalogue is not None:
        df = validate_texts(df, "generated_sql", catalogue).withColumnRenamed("reason", "_scan")
        scanned = F.col("_scan")
    if analysable is not None:
        df = df.join(analysable, "generated_sql", "left")
        an = F.coalesce(F.col("analysable"), F.lit(False))
    else:
        an = None
    incomplete = (F.coalesce(F.col("question"), F.lit("")) == "") | (F.coalesce(F.col("generated_sql"), F.lit("")) == "")
    reason = validation_reason(F.col("generated_sql"), an)
    if scanned is not None:
        reason = F.coalesce(scanned, reason)
    return df.withColumn(
        "status",
        F.when(incomplete, F.lit(SKIPPED)).when(reason.isNotNull(), F.lit(REJ_VALID)),
    ).withColumn("reason", F.when(incomplete, F.lit("missing question or SQL")).otherwise(reason)).drop("_scan")


def gate_stats(gated: DataFrame) -> DataFrame:
    """Counts per outcome in one row."""
    s = F.col("status")
    return gated.agg(
        F.count(F.when(s == APPROVED, 1)).alias("approved"),
        F.count(F.when(s == REJ_VALID, 1)).alias("rejected_validation"),
        F.count(F.when(s == REJ_DUP, 1)).alias("rejected_duplicate"),
        F.count(F.when(s == SKIPPED, 1)).alias("skipped"),
    )


def apply_dedup(
    gated: DataFrame,
    store_dups: DataFrame,
    edges: DataFrame,
    *,
    id_col: str = "trace_id",
) -> DataFrame:
    """Finish the statuses: candidates that are duplicates of the store
    (``store_dups``: id_col) or of an earlier *accepted* candidate (greedy
    over ``edges`` among the remaining candidates) are rejected_duplicate,
    the rest approved."""
    from askwell.operators.dedup import greedy_dedup

    cand = gated.filter(F.col("status").isNull()).select(id_col)
    vs_store = cand.join(store_dups.select(id_col).distinct(), id_col, "left_semi")
    rest = cand.join(vs_store, id_col, "left_anti")
    rest_ids = rest.select(F.col(id_col).alias("x"))
    e = (
        edges.join(rest_ids.withColumnRenamed("x", "src"), "src", "left_semi")
        .join(rest_ids.withColumnRenamed("x", "dst"), "dst", "left_semi")
    )
    greedy = greedy_dedup(rest, e, id_col=id_col)
    decided = vs_store.select(id_col, F.lit(REJ_DUP).alias("_s")).unionByName(
        greedy.select(id_col, F.when(F.col("kept"), F.lit(APPROVED)).otherwise(F.lit(REJ_DUP)).alias("_s"))
    )
    return (
        gated.join(decided, id_col, "left")
        .withColumn("status", F.coalesce(F.col("status"), F.col("_s")))
        .withColumn(
            "reason",
            F.when(F.col("status") == REJ_DUP, F.lit("duplicate")).otherwise(F.col("reason")),
        )
        .drop("_s")
    )


def process_feedback(
    traces: DataFrame,
    scores: DataFrame,
    store: DataFrame,
    *,
    threshold: float = 0.95,
    analysable: DataFrame | None = None,
    catalogue: DataFrame | None = None,
    name: str = SCORE_NAME,
    positive: float = POSITIVE_THRESHOLD,
) -> DataFrame:
    """ST1 feedback_once over a batch: returns one row per positive trace with
    (trace_id, seq, question, generated_sql, score_value, score_comment,
    status, reason).  ``store``: (question) of the examples already kept."""
    pos = first_positive(traces, scores, name=name, threshold=positive)
    return process_positives(pos, store, threshold=threshold, analysable=analysable, catalogue=catalogue)


def process_positives(
    pos: DataFrame,
    store: DataFrame,
    *,
    threshold: float = 0.95,
    analysable: DataFrame | None = None,
    catalogue: DataFrame | None = None,
) -> DataFrame:
    """Gates for positive records (trace_id, ts, question, generated_sql,
    score_value, score_comment).

    Arrival order is (trace ts, trace_id) -> ``seq``.  Similarity is the term
    cosine of the question texts (V0t) against the store's questions and
    among the batch; duplicates of the store or of an earlier accepted
    candidate are rejected (greedy, exact)."""
    from askwell.operators.ranking import global_rank
    from askwell.operators.text_similarity import undecided_pairs

    pos = global_rank(pos, [F.col("ts").asc(), F.col("trace_id").asc()], "seq")
    ensure_checkpoint_dir(pos.sparkSession)
    gated = gate_candidates(pos, analysable=analysable, catalogue=catalogue).checkpoint()
    cand = gated.filter(F.col("status").isNull()).select("seq", "question")
    # later copies of a candidate question are always duplicates (see dedup docs)
    edges, dup = undecided_pairs(cand, store, threshold, id_col="seq", text_col="question")
    dup = dup.select(F.col("id").alias("seq"))
    out = apply_dedup(
        gated,
        dup,
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst")),
        id_col="seq",
    )
    return out.select(
        "trace_id", "seq", "question", "generated_sql", "score_value", "score_comment", "status", "reason"
    )


def manual_add(
    spark: SparkSession,
    candidates: DataFrame,
    store: DataFrame | str,
    *,
    validate: bool = True,
    threshold: float = 0.95,
    catalogue: DataFrame | None = None,
) -> DataFrame:
    """Add hand-written examples (question, sql_query[, explanation,
    tables_used]) — optional validation (empty / write keyword, then the scan
    against ``catalogue`` or, without one, Spark's analysis of each text on the
    driver, meant for one person's additions), then the dedup gate against the
    store and among the batch in row order.

    ``store`` is the folder of an example store, to which what passes is appended
    as its next batch, or a frame (question) to check against only.  Returns each
    candidate with ``seq``, ``added`` and a message."""
    from askwell.sources import io as IO
    from askwell.operators.ranking import global_rank
    from askwell.operators.text_similarity import undecided_pairs

    path = store if isinstance(store, str) else None
    if path is not None:
        store = IO.read_store(spark, path)
    c = candidates.withColumn("_order", F.monotonically_increasing_id())
    c = global_rank(c, [F.col("_order").asc()], "seq").drop("_order")
    if validate and catalogue is not None:
        c = validate_texts(c, "sql_query", catalogue)
    elif validate:
        an = analysable_texts(spark, c.select(F.col("sql_query").alias("generated_sql")))
        c = c.join(an.withColumnRenamed("generated_sql", "sql_query"), "sql_query", "left")
        reason = validation_reason(F.col("sql_query"), F.coalesce(F.col("analysable"), F.lit(False)))
        c = c.withColumn("reason", reason).drop("analysable")
    else:
        c = c.withColumn("reason", F.lit(None).cast("string"))
    ensure_checkpoint_dir(spark)
    c = c.checkpoint()
    cand = c.filter(F.col("reason").isNull()).select("seq", "question")
    edges, dup = undecided_pairs(cand, store, threshold, id_col="seq", text_col="question")
    gated = c.withColumn("status", F.when(F.col("reason").isNotNull(), F.lit(REJ_VALID)))
    out = apply_dedup(gated, dup.select(F.col("id").alias("seq")),
                      edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), id_col="seq")
    msg = (
        F.when(F.col("status") == APPROVED, F.lit(ADDED))
        .when(F.col("status") == REJ_DUP, F.lit(DUPLICATE))
        .otherwise(F.concat(F.lit(FAILED), F.col("reason")))
    )
    out = out.withColumn("added", F.col("status") == APPROVED).withColumn("message", msg).drop("status", "reason")
    if path is not None:
        # decided once: the same rows are appended and returned
        out = out.checkpoint()
        batch = IO.next_batch(spark, path)
        fresh = out.filter("added").withColumn("example_id", F.concat_ws("-", F.lit("manual"), F.lit(batch), F.col("seq")))
        IO.append_examples(fresh.withColumn("created_at", F.current_timestamp()), path, batch)
    return out

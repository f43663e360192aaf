"""Scoring predicted SQL against gold SQL for all questions and strategies in
one plan (E1-E8, A10-A13, W6, O4, O5).

Results of executed queries are kept in long form, one line per result row:
``result_rows(question_id, side, row array<string>)`` where ``side`` is
'gold' or a strategy name, and ``executions(question_id, side, success)``
records whether each query ran.  Multiset comparison of all question /
strategy pairs is a single aggregation keyed by (question, strategy, row):
no result set is ever gathered in one place.  One row per question or pair is
still as many rows as there are questions, however small Spark takes it to be
(estimates miss that a column is exploded, sizes of shuffles are compressed): such
joins carry a merge hint, so the driver never builds a broadcast of them.
"""

from __future__ import annotations

import math
import re
import threading

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, IntegralType

from askwell.functions.numeric import round_ratio
from askwell.functions.text import REASON_WRITE, WRITE_PATTERN, is_blank, normalize_sql

GOLD = "gold"
# Evaluation outcomes and messages of the reference
CORRECT, INCORRECT = "correct", "incorrect"
ERR_EMPTY = "Empty prediction"
ERR_GOLD = "Gold SQL failed to execute"
ERR_PRED = "Predicted SQL failed to execute"
DIFFICULTY_ORDER = ("simple", "moderate", "challenging")


# --- X8 / result rows ------------------------------------------------------------------


def canonical_cells(df: DataFrame, digits: int = 4, columns: list[str] | None = None) -> Column:
    """One result row as array<string>.  Every numeric is rounded to
    ``digits`` and printed as DECIMAL(38, digits), so 15, 15.0 and 15.00004
    compare equal the way Python's int/float/Decimal equality does after the
    reference's rounding.  NaN, the infinities and values beyond that type keep
    their own text; a NULL is a null cell, which equals no text."""
    cols = columns or df.columns
    cells = []
    for name in cols:
        c = F.col("`" + name.replace("`", "``") + "`")
        text = c.cast("string")
        if isinstance(df.schema[name].dataType, (DecimalType, DoubleType, FloatType, IntegralType)):
            exact = F.round(c, digits).try_cast(f"decimal(38,{digits})").cast("string")
            text = F.coalesce(exact, text)
        cells.append(text)
    return F.array(*cells) if cells else F.array().cast("array<string>")


def result_rows(df: DataFrame, question_id: int, side: str, digits: int = 4, columns: list[str] | None = None) -> DataFrame:
    """Long form of one query result; its columns may have any names, equal ones too."""
    if columns is None:
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return df.select(
        F.lit(question_id).cast("bigint").alias("question_id"),
        F.lit(side).alias("side"),
        canonical_cells(df, digits, columns).alias("row"),
    )


# --- E2 / E3 ---------------------------------------------------------------------------------


def results_match(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """E2 in bulk: for every (question_id, strategy) in ``pairs``, is the
    multiset of predicted rows equal to the gold rows?  Both empty -> true;
    rows of different width never match.  Returns (question_id, strategy,
    execution_match)."""
    sides = pairs.groupBy("question_id").agg(F.collect_set("strategy").alias("strategies"))
    counts = rows.groupBy("question_id", "side", "row").agg(F.count(F.lit(1)).alias("n"))
    gold = counts.filter(F.col("side") == GOLD).select("question_id", "row", "n").join(sides.hint("merge"), "question_id")
    pred = counts.filter(F.col("side") != GOLD).select("question_id", F.col("side").alias("strategy"), "row", (-F.col("n")).alias("n"))
    # gold rows count up, predicted ones down; a row that is NULL equals none
    diff = gold.select("question_id", F.explode("strategies").alias("strategy"), "row", "n").unionByName(pred)
    diff = diff.groupBy("question_id", "strategy", "row").agg(F.sum("n").alias("n")).filter((F.col("n") != 0) | F.col("row").isNull())
    bad = diff.select("question_id", "strategy").distinct().withColumn("bad", F.lit(True))
    return pairs.select("question_id", "strategy").join(bad.hint("merge"), ["question_id", "strategy"], "left").select(
        "question_id", "strategy", F.col("bad").isNull().alias("execution_match")
    )


# --- E5 ---------------------------------------------------------------------------------------


def score_examples(
    questions: DataFrame,
    predictions: DataFrame,
    executions: DataFrame,
    matches: DataFrame,
) -> DataFrame:
    """E5: per (strategy, question) with the reference's order of checks:
    empty prediction -> error, everything false; exact match computed; gold
    failed -> error; prediction failed -> error, invalid; else valid + match.

    questions: (question_id, difficulty, gold_sql); predictions: (strategy,
    question_id, generated_sql); executions: (question_id, side, success);
    matches: output of ``results_match``."""
    gold_ok = executions.filter(F.col("side") == GOLD).select("question_id", F.col("success").alias("gold_ok"))
    pred_ok = executions.filter(F.col("side") != GOLD).select(
        "question_id", F.col("side").alias("strategy"), F.col("success").alias("pred_ok")
    )
    j = (
        predictions.join(questions.select("question_id", "difficulty", "gold_sql").hint("merge"), "question_id")
        .join(gold_ok.hint("merge"), "question_id", "left")
        .join(pred_ok.hint("merge"), ["question_id", "strategy"], "left")
        .join(matches.hint("merge"), ["question_id", "strategy"], "left")
    )
    empty = is_blank(F.col("generated_sql"))
    gold_fail = ~F.coalesce(F.col("gold_ok"), F.lit(False))
    pred_fail = ~F.coalesce(F.col("pred_ok"), F.lit(False))
    em = normalize_sql(F.col("gold_sql")) == normalize_sql(F.col("generated_sql"))
    return j.select(
        "strategy",
        "question_id",
        F.coalesce(F.col("difficulty"), F.lit("unknown")).alias("difficulty"),
        F.when(empty | gold_fail | pred_fail, F.lit(False))
        .otherwise(F.coalesce(F.col("execution_match"), F.lit(False)))
        .alias("execution_match"),
        F.when(empty | gold_fail | pred_fail, F.lit(False)).otherwise(F.lit(True)).alias("valid_sql"),
        F.when(empty, F.lit(False)).otherwise(em).alias("exact_match"),
        F.when(empty, F.lit(ERR_EMPTY)).when(gold_fail, F.lit(ERR_GOLD)).when(pred_fail, F.lit(ERR_PRED)).alias("error"),
    )


def exact_match(gold_sql: Column, pred_sql: Column) -> Column:
    """E1."""
    return normalize_sql(gold_sql) == normalize_sql(pred_sql)


# --- A10 / A11 / O5 / W6 ------------------------------------------------------------------------


def _rate(flag: str) -> Column:
    return F.coalesce(
        round_ratio(F.sum(F.col(flag).cast("int")), F.count(F.lit(1)), 4), F.lit(0).cast("decimal(38,4)")
    )


def strategy_summary(scored: DataFrame) -> DataFrame:
    """A10: total and EX / VR / EM rates at 4 dp per strategy."""
    return scored.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("total"),
        _rate("execution_match").alias("execution_accuracy"),
        _rate("valid_sql").alias("valid_sql_rate"),
        _rate("exact_match").alias("exact_match_rate"),
    )


def accuracy_by_difficulty(scored: DataFrame) -> DataFrame:
    """Count and EX rate per (strategy, difficulty)."""
    return scored.groupBy("strategy", "difficulty").agg(
        F.count(F.lit(1)).alias("count"), _rate("execution_match").alias("execution_accuracy")
    )


def strategy_leaderboard(summary: DataFrame) -> DataFrame:
    """Strategies by EX desc (name as tie-break), every strategy tied for
    the best flagged.  Runs on the per-strategy summary (one row each)."""
    best = summary.agg(F.max("execution_accuracy")).scalar()
    return summary.withColumn("is_best", F.col("execution_accuracy") == best).orderBy(
        F.desc("execution_accuracy"), "strategy"
    )


def running_accuracy(scored: DataFrame, every: int = 10, order_col: str = "question_id") -> DataFrame:
    """EX over the first i questions of each strategy, reported at every
    ``every``-th question and at the last one.  The prefix sums are computed
    per range partition plus offsets (no single-partition window)."""
    from askwell.operators.ranking import global_prefix_sums

    df = scored.select("strategy", order_col, F.col("execution_match").cast("int").alias("hit"))
    pref = global_prefix_sums(df, ["strategy"], [order_col], ["hit"])
    totals = df.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    out = pref.join(totals, "strategy").filter((F.col("_i") % every == 0) | (F.col("_i") == F.col("n")))
    return out.select(
        "strategy",
        F.col("_i").alias("i"),
        round_ratio(F.col("hit_cum"), F.col("_i"), 4).alias("running_accuracy"),
    )


# --- O4 --------------------------------------------------------------------------------------


def preview_rows(rows: DataFrame, n: int = 25) -> DataFrame:
    """The first n rows per (question_id, side) by canonical text, and how
    many more there are ("... and N more rows")."""
    key = ["question_id", "side"]
    w = Window.partitionBy(*key).orderBy("row")
    # the rank filter drops rows beyond n before the shuffle
    first = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    shown = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_rn", "row"))).alias("_shown"))
    more = rows.groupBy(*key).agg(F.greatest(F.count(F.lit(1)) - F.lit(n), F.lit(0)).alias("n_more"))
    return more.join(shown, key).select(*key, F.transform("_shown", lambda s: s["row"]).alias("shown"), "n_more")


# --- E3 / E4 -----------------------------------------------------------------------------------


def lenient_rows(gold: DataFrame, pred: DataFrame, question_id: int, strategy: str) -> DataFrame | None:
    """E3 (README rule): floats at 2 dp; the prediction may carry extra
    columns — it is projected to the gold's column names first.  Returns the
    long-form rows of both sides, or None when a gold column is missing."""
    missing = [c for c in gold.columns if c not in pred.columns]
    if missing:
        return None
    return result_rows(gold, question_id, GOLD, 2).unionByName(
        result_rows(pred, question_id, strategy, 2, columns=gold.columns)
    )


def answers_within_1pct(gold: DataFrame, pred: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Same keys on both sides and every value within 1 % of the gold
    value.  Returns one row (match boolean, n_keys, n_bad)."""
    g = gold.select(*keys, *[F.col(v).cast("double").alias(f"g_{v}") for v in values]).withColumn("_g", F.lit(True))
    p = pred.select(*keys, *[F.col(v).cast("double").alias(f"p_{v}") for v in values]).withColumn("_p", F.lit(True))
    j = g.join(p, keys, "full_outer")
    ok = F.col("_g").isNotNull() & F.col("_p").isNotNull()
    for v in values:
        a, b = F.col(f"g_{v}"), F.col(f"p_{v}")
        ok = ok & ((a.isNull() & b.isNull()) | (F.abs(a - b) <= F.lit(0.01) * F.abs(a)))
    return j.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count(F.when(~ok, 1)).alias("n_bad")
    ).withColumn("match", F.col("n_bad") == 0)


def named_rows(df: DataFrame, question: str, side: Column | str, digits: int = 2) -> DataFrame:
    """Result rows of many questions as maps from column name to canonical cell:
    (question_id, side, cells).  ``question`` names the question's column; all
    others are the result's."""
    names = [c for c in df.columns if c != question]
    cells = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), canonical_cells(df, digits, names))
    return df.select(F.col(question).cast("bigint").alias("question_id"), (F.lit(side) if isinstance(side, str) else side).alias("side"), cells.alias("cells"))


def lenient_match(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """E3 for all questions at once: is the multiset of predicted rows, cut to the
    gold result's columns, that of the gold rows?  A prediction that lacks a gold
    column never matches.  ``named``: output of ``named_rows`` for all sides;
    ``pairs``: (question_id, strategy).  Returns (question_id, strategy,
    lenient_match)."""
    # the same in all rows of a result: told apart by hash first, so that few reach the sort of ``first``
    columns = named.filter(F.col("side") == GOLD).select("question_id", F.array_sort(F.map_keys("cells")).alias("columns"))
    columns = columns.distinct().groupBy("question_id").agg(F.first("columns").alias("columns"))
    joined = named.join(columns.hint("merge"), "question_id", "left")
    lacks = F.exists("columns", lambda c: ~F.map_contains_key("cells", c))
    cut = joined.select(
        "question_id",
        "side",
        F.coalesce(F.transform("columns", lambda c: F.col("cells")[c]), F.array().cast("array<string>")).alias("row"),
        F.coalesce(lacks, F.lit(False)).alias("lacks"),
    )
    short = cut.filter("lacks").select("question_id", F.col("side").alias("strategy")).distinct().withColumn("short", F.lit(True))
    same = results_match(cut.select("question_id", "side", "row"), pairs)
    return same.join(short.hint("merge"), ["question_id", "strategy"], "left").select(
        "question_id", "strategy", (F.col("execution_match") & F.col("short").isNull()).alias("lenient_match")
    )


def within_1pct(gold: DataFrame, predicted: DataFrame, pairs: DataFrame, share: float = 0.01) -> DataFrame:
    """E4 for all questions at once: every gold value has a predicted one within
    1 % of it, and every predicted value has such a gold one.

    ``gold``: (question_id, value); ``predicted``: (question_id, strategy, value);
    ``pairs``: (question_id, strategy).  Values meet in buckets as wide as the
    tolerance on a logarithmic scale, gold values in their own and both next ones,
    so a question with very many values forms no pairs beyond near ones.  NULL
    values are left out; zero matches zero alone.  Returns (question_id,
    strategy, n_gold, n_gold_bad, n_pred_bad, within)."""
    width = -math.log(1 - share) * 1.0001
    v = F.col("value")

    def bucketed(df: DataFrame) -> DataFrame:
        df = df.withColumn("value", v.cast("double")).filter(v.isNotNull()).distinct()
        return df.withColumn("sign", F.signum("value")).withColumn(
            "bucket", F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(v)) / F.lit(width))).cast("long")
        )

    g, p = bucketed(gold.select("question_id", "value")), bucketed(predicted.select("question_id", "strategy", "value"))
    around = g.select("question_id", F.col("value").alias("gold"), "sign", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("bucket"))
    near = p.join(around, ["question_id", "sign", "bucket"]).filter(
        F.abs(v - F.col("gold")) <= F.lit(share) * F.abs("gold")
    ).select("question_id", "strategy", "gold", "value")
    n_gold = g.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_gold"))
    n_pred = p.groupBy("question_id", "strategy").agg(F.count(F.lit(1)).alias("n_pred"))
    met = near.groupBy("question_id", "strategy").agg(
        F.countDistinct("gold").alias("gold_met"), F.countDistinct("value").alias("pred_met")
    )
    zero = F.lit(0).cast("long")
    out = (
        pairs.select("question_id", "strategy").join(n_gold, "question_id", "left")
        .join(n_pred, ["question_id", "strategy"], "left").join(met, ["question_id", "strategy"], "left")
        .select(
            "question_id", "strategy", F.coalesce("n_gold", zero).alias("n_gold"),
            (F.coalesce("n_gold", zero) - F.coalesce("gold_met", zero)).alias("n_gold_bad"),
            (F.coalesce("n_pred", zero) - F.coalesce("pred_met", zero)).alias("n_pred_bad"),
        )
    )
    return out.withColumn("within", (F.col("n_gold_bad") == 0) & (F.col("n_pred_bad") == 0))


# --- phases: E6 / E7 / E8 / A13 ----------------------------------------------------------------


def phase_verdict(pred_ok: Column, gold_ok: Column, judge: Column) -> Column:
    """Prediction failed or gold failed -> incorrect; else the judge's
    verdict (starts with EQUIVALENT, any case) -> correct."""
    return (
        F.when(~pred_ok, F.lit(INCORRECT))
        .when(~gold_ok, F.lit(INCORRECT))
        .when(F.upper(F.ltrim(F.coalesce(judge, F.lit("")))).startswith("EQUIVALENT"), F.lit(CORRECT))
        .otherwise(F.lit(INCORRECT))
    )


def phase_accuracy(phase_results: DataFrame, baseline: str = "baseline", learned: str = "with_learning") -> DataFrame:
    """Per phase total, correct, accuracy and valid-SQL rate (4 dp),
    plus improvement in percentage points at 1 dp (learned - baseline)."""
    per = phase_results.groupBy("phase").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("verdict") == CORRECT, 1)).alias("correct"),
        F.sum(F.col("valid_sql").cast("int")).alias("valid"),
    )
    out = per.select(
        "phase", "total", "correct",
        F.coalesce(round_ratio(F.col("correct"), F.col("total"), 4), F.lit(0).cast("decimal(38,4)")).alias("accuracy"),
        F.coalesce(round_ratio(F.col("valid"), F.col("total"), 4), F.lit(0).cast("decimal(38,4)")).alias("valid_sql_rate"),
    )
    # exact pp difference: (c_l/t_l - c_b/t_b) * 100 at 1 dp, computed from counts
    b = per.filter(F.col("phase") == baseline).select(F.col("correct").alias("cb"), F.col("total").alias("tb"))
    l_ = per.filter(F.col("phase") == learned).select(F.col("correct").alias("cl"), F.col("total").alias("tl"))
    diff = b.join(l_, how="inner").select(
        (F.col("cl") * F.col("tb") - F.col("cb") * F.col("tl")).alias("num"),
        (F.col("tb") * F.col("tl")).alias("den"),
    )
    imp = diff.select(
        F.when(F.col("num") >= 0, round_ratio(F.col("num") * 100, F.col("den"), 1))
        .otherwise(-round_ratio(-F.col("num") * 100, F.col("den"), 1))
        .alias("improvement_pp")
    ).scalar()
    return out.withColumn("improvement_pp", imp)


def flips(phase_results: DataFrame, baseline: str = "baseline", learned: str = "with_learning") -> DataFrame:
    """Questions fixed (incorrect -> correct) or regressed by learning."""
    b = phase_results.filter(F.col("phase") == baseline).select("question_id", F.col("verdict").alias("b"))
    l_ = phase_results.filter(F.col("phase") == learned).select("question_id", "difficulty", F.col("verdict").alias("l"))
    j = b.join(l_.hint("merge"), "question_id")
    kind = F.when((F.col("b") == INCORRECT) & (F.col("l") == CORRECT), F.lit("fixed")).when(
        (F.col("b") == CORRECT) & (F.col("l") == INCORRECT), F.lit("regressed")
    )
    return j.select("question_id", "difficulty", kind.alias("flip")).filter(F.col("flip").isNotNull())


def phase_comparison(phase_results: DataFrame, baseline: str = "baseline", learned: str = "with_learning") -> DataFrame:
    """Per difficulty (fixed order simple, moderate, challenging; missing
    -> 0): count, baseline accuracy, learned accuracy, delta in pp (1 dp)."""
    spark = phase_results.sparkSession
    order = spark.createDataFrame([(d, i) for i, d in enumerate(DIFFICULTY_ORDER)], "difficulty string, ord int")
    per = phase_results.groupBy("difficulty").pivot("phase", [baseline, learned]).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("verdict") == CORRECT, 1)).alias("c")
    )
    j = order.join(per, "difficulty", "left")
    nb, cb = F.coalesce(F.col(f"{baseline}_n"), F.lit(0)), F.coalesce(F.col(f"{baseline}_c"), F.lit(0))
    nl, cl = F.coalesce(F.col(f"{learned}_n"), F.lit(0)), F.coalesce(F.col(f"{learned}_c"), F.lit(0))
    zero = F.lit(0).cast("decimal(38,4)")
    num = cl * nb - cb * nl
    den = nb * nl
    delta = F.when(den == 0, F.lit(0).cast("decimal(38,1)")).when(
        num >= 0, round_ratio(num * 100, den, 1)
    ).otherwise(-round_ratio(-num * 100, den, 1))
    return j.select(
        "difficulty",
        nb.alias("count"),
        F.coalesce(round_ratio(cb, nb, 4), zero).alias("baseline_accuracy"),
        F.coalesce(round_ratio(cl, nl, 4), zero).alias("learned_accuracy"),
        delta.alias("delta_pp"),
        "ord",
    ).orderBy("ord").drop("ord")


# --- E11 ---------------------------------------------------------------------------------------


def run_queries(
    spark,
    texts: list[tuple[int, str, str]],
    *,
    digits: int = 4,
    timeout_s: float | None = None,
    at_once: int = 8,
    materialize_to: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run read-only SQL texts; returns (result_rows, executions).

    ``texts``: (question_id, side, sql), each pair of id and side once.  A text
    passes the write guard first (commands would execute eagerly in
    ``spark.sql``), then is analysed and run; what fails is one line of
    ``executions`` with ``success = false`` and the error's first line.

    ``at_once`` texts run at a time, each from a thread of its own with a job tag
    and a fair-scheduler pool of its own, so that a long text doesn't hold the
    others up (pools share the executors where ``spark.scheduler.mode`` is FAIR).
    After ``timeout_s`` seconds a text's jobs are cancelled by its tag.  Rows are
    written to ``materialize_to`` (default: a new folder under the shared
    checkpoint location), one folder a text, and read back as one table: a lost
    executor reruns tasks of one text, and the plan doesn't grow with the texts.
    ``n_rows`` of a text that ran is counted from what it wrote."""
    import logging
    import uuid
    from concurrent.futures import ThreadPoolExecutor

    from askwell.session import scratch_path

    # analysis failures are expected outcomes here, not errors to log
    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)
    if len({(q, side) for q, side, _ in texts}) < len(texts):
        raise ValueError("run_queries: a question and side stands in texts twice")
    run_id = uuid.uuid4().hex
    folder = (materialize_to or scratch_path(spark, f"queries-{run_id}")).rstrip("/")

    def run(i: int) -> tuple[bool, str | None]:
        return _run_text(spark, texts[i], f"{folder}/text={i}", f"askwell-{run_id}-{i}", digits, timeout_s)

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        # wrapped one by one: each text gets its own copy of the caller's local properties
        outcomes = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), i) for i in range(len(texts))]]
    ran = [f"{folder}/text={i}" for i, (ok, _) in enumerate(outcomes) if ok]
    schema = "question_id long, side string, row array<string>"
    rows = spark.read.schema(schema).parquet(*ran) if ran else spark.createDataFrame([], schema)
    status = spark.createDataFrame(
        [(q, side, ok, error) for (q, side, _), (ok, error) in zip(texts, outcomes, strict=True)],
        "question_id long, side string, success boolean, error string",
    )
    counts = rows.groupBy("question_id", "side").agg(F.count(F.lit(1)).alias("n"))
    executions = status.join(counts, ["question_id", "side"], "left").select(
        "question_id", "side", "success", "error",
        F.when(F.col("success"), F.coalesce("n", F.lit(0))).cast("long").alias("n_rows"),
    )
    return rows, executions


def _run_text(spark, text: tuple[int, str, str], path: str, tag: str, digits: int, timeout_s: float | None) -> tuple[bool, str | None]:
    """Run one text into ``path``: whether it ran, and why not."""
    qid, side, sql = text
    if not sql or not sql.strip():
        return False, "empty"
    if re.search(WRITE_PATTERN.replace("(?i)", ""), sql.strip().rstrip(";"), re.IGNORECASE):
        return False, REASON_WRITE
    try:
        df = spark.sql(sql.strip().rstrip(";"))
    except Exception as exc:  # unknown table or column, syntax
        return False, _first_line(exc)
    sc = spark.sparkContext
    late = threading.Event()

    def cancel() -> None:
        late.set()
        # a job that starts later carries the tag too, so go on until the thread is done
        while not done.wait(0.2):
            sc.cancelJobsWithTag(tag)

    done = threading.Event()
    timer = threading.Timer(timeout_s, cancel) if timeout_s else None
    sc.addJobTag(tag)
    sc.setLocalProperty("spark.scheduler.pool", tag)
    try:
        if timer:
            timer.daemon = True
            timer.start()
        result_rows(df, qid, side, digits).write.mode("overwrite").parquet(path)
        return True, None
    except Exception as exc:  # failed or cancelled while running
        return False, f"timed out after {timeout_s} s" if late.is_set() else f"execution failed: {_first_line(exc)}"
    finally:
        done.set()
        if timer:
            timer.cancel()
        sc.removeJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", None)


def _first_line(exc: Exception) -> str:
    return (str(exc).splitlines() or [type(exc).__name__])[0][:500]

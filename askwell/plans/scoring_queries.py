"""Scoring of predicted against gold results: one question per customer.

The question is what the customer ordered month by month; the gold rows leave
out pending orders.  Three strategies answer it, each by its own definition over
the whole ``orders`` table:
  * dynamic_few_shot - the gold definition (its text only spaced otherwise), but
    closed orders alone for every tenth customer
  * zero_shot        - pending orders are not left out
  * static_few_shot  - one total, so its rows have another width
Some gold and predicted queries failed and some predictions are blank, by the
question's number.  A month without urgent orders has a NULL cell.
Phases for E6-E8/A13: baseline = zero_shot, with_learning = dynamic_few_shot;
the judge verdict is EQUIVALENT iff the result sets match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.functions.numeric import sql_round_ratio
from askwell.operators import scoring as S
from askwell.plans.catalog import register
from askwell.sources.tables import Tables

ZERO, STATIC, DYNAMIC = "zero_shot", "static_few_shot", "dynamic_few_shot"
STRATEGIES = (ZERO, STATIC, DYNAMIC)
_SELECT = "SELECT month, SUM(amount), MAX(urgent) FROM orders WHERE customer = "


def _gold_ok(q: Column) -> Column:
    return q % 97 != 5


def _pred_ok(q: Column, strategy: Column) -> Column:
    return F.when(strategy == DYNAMIC, q % 50 != 11).when(strategy == STATIC, q % 20 != 3).otherwise(F.lit(True))


def _blank(q: Column) -> Column:
    return q % 25 == 7


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("c_custkey")
    level = F.when(q % 4 == 0, "simple").when(q % 4 == 1, "moderate").when(q % 4 == 2, "challenging")
    gold = F.concat(F.lit(_SELECT), q.cast("string"), F.lit(" AND status NOT IN ('P') GROUP BY month"))
    return Tables(spark, sf_dir).customer.select(q.alias("question_id"), level.alias("difficulty"), gold.alias("gold_sql"))


def predictions(asked: DataFrame) -> DataFrame:
    q = F.col("question_id")
    who = q.cast("string")
    closed = F.concat(F.lit(_SELECT), who, F.lit(" AND status IN ('F') GROUP BY month"))
    spaced = F.concat(F.lit("  " + _SELECT.replace(" FROM", "\n  from")), who, F.lit(" AND status NOT IN ( 'P' )  GROUP BY month;"))
    texts = {
        ZERO: F.when(_blank(q), F.lit("  ")).otherwise(F.concat(F.lit(_SELECT), who, F.lit(" GROUP BY month"))),
        STATIC: F.lit("SELECT SUM(amount) FROM orders"),
        DYNAMIC: F.when(q % 10 == 9, closed).otherwise(spaced),
    }
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), t.alias("generated_sql")) for s, t in texts.items()]))
    return asked.select("question_id", each.alias("p")).select("p.strategy", "question_id", "p.generated_sql")


def executions(preds: DataFrame) -> DataFrame:
    q, s = F.col("question_id"), F.col("strategy")
    return preds.select(q, s.alias("side"), _pred_ok(q, s).alias("success")).unionByName(
        preds.filter(s == ZERO).select(q, F.lit(S.GOLD).alias("side"), _gold_ok(q).alias("success"))
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of all sides from one pass: orders are summed per customer,
    month and status first, and only those sums are dealt to the sides."""
    by = Tables(spark, sf_dir).orders.groupBy(
        F.col("o_custkey").alias("question_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("o_orderstatus").alias("status"),
    ).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("urgent"),
    )
    q, st, side = F.col("question_id"), F.col("status"), F.col("side")
    sides = F.array_compact(F.array(
        F.when((st != "P") & _gold_ok(q), S.GOLD),
        F.when((st != "P") & ~((q % 10 == 9) & (st == "O")) & _pred_ok(q, F.lit(DYNAMIC)), DYNAMIC),
        F.when(~_blank(q), ZERO),
        F.when((st != "P") & _pred_ok(q, F.lit(STATIC)), STATIC),
    ))
    total = F.sum("amount").cast("decimal(38,4)").cast("string")
    return (
        by.select("question_id", F.explode(sides).alias("side"), "month", "amount", "urgent")
        .withColumn("month", F.when(side != STATIC, F.col("month")))
        .groupBy("question_id", "side", "month")
        .agg(total.alias("total"), F.max("urgent").alias("urgent"))
        .select("question_id", "side", F.when(side == STATIC, F.array("total")).otherwise(F.array("month", "total", "urgent")).alias("row"))
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    preds = predictions(asked)
    matches = S.results_match(rows(spark, sf_dir), preds.select("question_id", "strategy"))
    return S.score_examples(asked, preds, executions(preds), matches)


def _phases(df: DataFrame) -> DataFrame:
    gold_ok = F.col("error").isNull() | (F.col("error") != S.ERR_GOLD)
    judge = F.when(F.col("execution_match"), "EQUIVALENT: same rows").otherwise("DIFFERENT: rows differ")
    return df.filter(F.col("strategy").isin(ZERO, DYNAMIC)).select(
        F.when(F.col("strategy") == ZERO, "baseline").otherwise("with_learning").alias("phase"),
        "question_id", "difficulty", "valid_sql",
        S.phase_verdict(F.col("error").isNull(), gold_ok, judge).alias("verdict"),
    )


def s_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of each side, as one text, and how many more."""
    shown = F.array_join(F.transform("shown", lambda r: F.array_join(r, ",", "-")), ";")
    return S.preview_rows(rows(spark, sf_dir), 5).select("question_id", "side", shown.alias("shown"), "n_more")


# ---- the same as DuckDB SQL ---------------------------------------------------


def _norm(text: str) -> str:
    s = f"lower(regexp_replace(regexp_replace({text}, '^\\s+|\\s+$', '', 'g'), ';+$', ''))"
    for pattern, new in ((r"\s+", " "), (r"\(\s+", "("), (r"\s+\)", ")")):
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    return s


_Q = _SELECT.replace("'", "''")
_ROWS = """o AS (
  SELECT o_custkey AS q, strftime(o_orderdate, '%Y-%m') AS m, o_orderstatus AS st, CAST(o_totalprice AS DECIMAL(18,2)) AS amt,
    CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') END AS urgent
  FROM orders),
dealt AS (
  SELECT q, 'gold' AS side, m, amt, urgent FROM o WHERE st <> 'P' AND q % 97 <> 5
  UNION ALL SELECT q, 'dynamic_few_shot', m, amt, urgent FROM o WHERE st <> 'P' AND NOT (q % 10 = 9 AND st = 'O') AND q % 50 <> 11
  UNION ALL SELECT q, 'zero_shot', m, amt, urgent FROM o WHERE q % 25 <> 7
  UNION ALL SELECT q, 'static_few_shot', '', amt, '' FROM o WHERE st <> 'P' AND q % 20 <> 3),
res AS (
  SELECT q, side, CASE WHEN side = 'static_few_shot' THEN t ELSE m || ',' || t || ',' || coalesce(urgent, '-') END AS r
  FROM (SELECT q, side, m, CAST(CAST(SUM(amt) AS DECIMAL(38,4)) AS VARCHAR) AS t, MAX(urgent) AS urgent FROM dealt GROUP BY q, side, m))"""
_SCORED = f"""{_ROWS},
lists AS (SELECT q, side, string_agg(r, ';' ORDER BY r) AS r FROM res GROUP BY q, side),
asked AS (
  SELECT c_custkey AS q, CASE c_custkey % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' WHEN 2 THEN 'challenging' ELSE 'unknown' END AS difficulty,
    '{_Q}' || c_custkey || ' AND status NOT IN (''P'') GROUP BY month' AS gold
  FROM customer),
pred AS (
  SELECT q, 'zero_shot' AS strategy, CASE WHEN q % 25 = 7 THEN '  ' ELSE '{_Q}' || q || ' GROUP BY month' END AS p, true AS ok FROM asked
  UNION ALL SELECT q, 'static_few_shot', 'SELECT SUM(amount) FROM orders', q % 20 <> 3 FROM asked
  UNION ALL SELECT q, 'dynamic_few_shot', CASE WHEN q % 10 = 9 THEN '{_Q}' || q || ' AND status IN (''F'') GROUP BY month'
    ELSE '   ' || '{_Q}' || q || '  AND status NOT IN ( ''P'' ) GROUP BY month;' END, q % 50 <> 11 FROM asked),
judged AS (
  SELECT strategy, a.q, difficulty, gold, p, trim(p) = '' AS empty, a.q % 97 = 5 AS gold_bad, NOT ok AS pred_bad,
    g.r IS NOT DISTINCT FROM l.r AS same
  FROM pred JOIN asked a ON pred.q = a.q
  LEFT JOIN lists g ON g.q = a.q AND g.side = 'gold' LEFT JOIN lists l ON l.q = a.q AND l.side = strategy),
scored AS (
  SELECT strategy, q AS question_id, difficulty, NOT (empty OR gold_bad OR pred_bad) AND same AS execution_match,
    NOT (empty OR gold_bad OR pred_bad) AS valid_sql, NOT empty AND {_norm('gold')} = {_norm('p')} AS exact_match,
    CASE WHEN empty THEN '{S.ERR_EMPTY}' WHEN gold_bad THEN '{S.ERR_GOLD}' WHEN pred_bad THEN '{S.ERR_PRED}' END AS error
  FROM judged)"""


def _hits(flag: str) -> str:
    return sql_round_ratio(f"COUNT(*) FILTER (WHERE {flag})", "COUNT(*)", 4)


def _points(num: str, den: str) -> str:
    return f"CASE WHEN {num} >= 0 THEN {sql_round_ratio(f'({num}) * 100', den, 1)} ELSE -{sql_round_ratio(f'-({num}) * 100', den, 1)} END"


_SUMMARY = f"""SELECT strategy, COUNT(*) AS total, {_hits('execution_match')} AS execution_accuracy,
  {_hits('valid_sql')} AS valid_sql_rate, {_hits('exact_match')} AS exact_match_rate FROM scored GROUP BY strategy"""
_PHASES = f"""{_SCORED},
ph AS (SELECT question_id, difficulty, valid_sql, execution_match AS good,
  CASE strategy WHEN 'zero_shot' THEN 'baseline' ELSE 'with_learning' END AS phase
  FROM scored WHERE strategy <> 'static_few_shot')"""

register("s_scored", scored, f"WITH {_SCORED} SELECT * FROM scored")
register("s_strategy_summary", lambda s, d: S.strategy_summary(scored(s, d)), f"WITH {_SCORED} {_SUMMARY}")
register(
    "s_accuracy_by_difficulty", lambda s, d: S.accuracy_by_difficulty(scored(s, d)),
    f"WITH {_SCORED} SELECT strategy, difficulty, COUNT(*) AS count, {_hits('execution_match')} AS execution_accuracy FROM scored GROUP BY ALL",
)
register(
    "s_leaderboard", lambda s, d: S.strategy_leaderboard(S.strategy_summary(scored(s, d))),
    f"WITH {_SCORED}, y AS ({_SUMMARY}) SELECT *, execution_accuracy = (SELECT MAX(execution_accuracy) FROM y) AS is_best FROM y ORDER BY execution_accuracy DESC, strategy",
)
register(
    "s_running_accuracy", lambda s, d: S.running_accuracy(scored(s, d)),
    f"""WITH {_SCORED}, n AS (
  SELECT strategy, ROW_NUMBER() OVER w AS i, SUM(CAST(execution_match AS INT)) OVER w AS hits, COUNT(*) OVER (PARTITION BY strategy) AS total
  FROM scored WINDOW w AS (PARTITION BY strategy ORDER BY question_id ROWS UNBOUNDED PRECEDING))
SELECT strategy, i, {sql_round_ratio('hits', 'i', 4)} AS running_accuracy FROM n WHERE i % 10 = 0 OR i = total""",
)
register(
    "s_preview", s_preview,
    f"""WITH {_ROWS}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY q, side ORDER BY r) AS i FROM res)
SELECT q AS question_id, side, string_agg(r, ';' ORDER BY r) FILTER (WHERE i <= 5) AS shown, GREATEST(COUNT(*) - 5, 0) AS n_more FROM n GROUP BY q, side""",
)
register(
    "s_phase_accuracy", lambda s, d: S.phase_accuracy(_phases(scored(s, d))),
    f"""WITH {_PHASES}, t AS (
  SELECT phase, COUNT(*) AS total, COUNT(*) FILTER (WHERE good) AS correct, {_hits('good')} AS accuracy, {_hits('valid_sql')} AS valid_sql_rate
  FROM ph GROUP BY phase)
SELECT t.*, {_points('l.correct * b.total - b.correct * l.total', 'b.total * l.total')} AS improvement_pp
FROM t, (SELECT * FROM t WHERE phase = 'baseline') b, (SELECT * FROM t WHERE phase = 'with_learning') l""",
)
register(
    "s_flips", lambda s, d: S.flips(_phases(scored(s, d))),
    f"""WITH {_PHASES} SELECT l.question_id, l.difficulty, CASE WHEN l.good THEN 'fixed' ELSE 'regressed' END AS flip
FROM ph l JOIN ph b ON b.question_id = l.question_id AND b.phase = 'baseline' AND l.phase = 'with_learning' WHERE l.good <> b.good""",
)
register(
    "s_phase_comparison", lambda s, d: S.phase_comparison(_phases(scored(s, d))),
    f"""WITH {_PHASES}, c AS (
  SELECT difficulty, COUNT(*) FILTER (WHERE phase = 'baseline') AS nb, COUNT(*) FILTER (WHERE phase = 'baseline' AND good) AS cb,
    COUNT(*) FILTER (WHERE phase = 'with_learning') AS nl, COUNT(*) FILTER (WHERE phase = 'with_learning' AND good) AS cl
  FROM ph GROUP BY difficulty)
SELECT difficulty, nb AS count, {sql_round_ratio('cb', 'nb', 4)} AS baseline_accuracy, {sql_round_ratio('cl', 'nl', 4)} AS learned_accuracy,
  {_points('cl * nb - cb * nl', 'nb * nl')} AS delta_pp
FROM c WHERE difficulty IN ('simple', 'moderate', 'challenging')""",
)


# --- E3 / E4 over the same orders: other shapes and roundings of the monthly totals ---

MORE, RENAMED, ROUGH = "more_columns", "renamed", "thousands"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's months: orders that are not pending, and their total."""
    o = Tables(spark, sf_dir).orders
    return o.filter(F.col("o_orderstatus") != "P").groupBy(
        F.col("o_custkey").alias("question_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month")
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count(F.lit(1)).alias("n_orders"))


def lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction with an extra column and other decimals (for every sixth
    customer beyond two places), one whose total has another name for every
    fourth customer, and one in whole thousands."""
    by, q = _monthly(spark, sf_dir), F.col("question_id")
    pairs = Tables(spark, sf_dir).customer.select(
        F.col("c_custkey").alias("question_id"), F.explode(F.array(F.lit(MORE), F.lit(RENAMED), F.lit(ROUGH))).alias("strategy")
    )
    more = F.col("total").cast("decimal(24,4)") + F.when(q % 6 == 0, F.lit(0.01)).otherwise(F.lit(0.004)).cast("decimal(5,4)")
    shapes = [
        S.named_rows(by.select("question_id", "month", "total"), "question_id", S.GOLD),
        S.named_rows(by.select("question_id", "n_orders", more.alias("total"), "month"), "question_id", MORE),
        S.named_rows(by.filter(q % 4 == 0).select("question_id", "month", F.col("total").alias("amount")), "question_id", RENAMED),
        S.named_rows(by.filter(q % 4 != 0).select("question_id", "month", "total"), "question_id", RENAMED),
        S.named_rows(by.select("question_id", "month", F.round("total", -3).alias("total")), "question_id", ROUGH),
    ]
    named = shapes[0]
    for more_rows in shapes[1:]:
        named = named.unionByName(more_rows)
    return S.lenient_match(named, pairs)


def near_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months' totals against totals in whole thousands, and against
    totals of all orders, pending ones too."""
    by = _monthly(spark, sf_dir)
    every = Tables(spark, sf_dir).orders.groupBy(
        F.col("o_custkey").alias("question_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month")
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    pairs = Tables(spark, sf_dir).customer.select(
        F.col("c_custkey").alias("question_id"), F.explode(F.array(F.lit(ROUGH), F.lit(ZERO))).alias("strategy")
    )
    predicted = by.select("question_id", F.lit(ROUGH).alias("strategy"), F.round("total", -3).alias("value")).unionByName(
        every.select("question_id", F.lit(ZERO).alias("strategy"), F.col("total").alias("value")), allowMissingColumns=False
    )
    return S.within_1pct(by.select("question_id", F.col("total").alias("value")), predicted, pairs)


_MONTHLY = """m AS (
  SELECT o_custkey AS q, strftime(o_orderdate, '%Y-%m') AS m, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS t
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)"""
register("s_lenient_match", lenient, f"""WITH {_MONTHLY},
same AS (SELECT q, bool_and(round(t, -3) = t) AS whole FROM m GROUP BY q)
SELECT c_custkey AS question_id, s.strategy, CASE s.strategy
    WHEN '{MORE}' THEN c_custkey % 6 <> 0 OR same.q IS NULL
    WHEN '{RENAMED}' THEN c_custkey % 4 <> 0 OR same.q IS NULL
    ELSE coalesce(whole, true) END AS lenient_match
FROM customer CROSS JOIN (SELECT unnest(['{MORE}', '{RENAMED}', '{ROUGH}']) AS strategy) s LEFT JOIN same ON same.q = c_custkey""")
register("s_within_1pct", near_answers, f"""WITH {_MONTHLY},
g AS (SELECT DISTINCT q, CAST(t AS DOUBLE) AS v FROM m),
p AS (SELECT DISTINCT * FROM (
  SELECT q, '{ROUGH}' AS s, CAST(round(t, -3) AS DOUBLE) AS v FROM m UNION ALL
  SELECT o_custkey, '{ZERO}', CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders
  GROUP BY o_custkey, strftime(o_orderdate, '%Y-%m')) x),
pairs AS (SELECT c_custkey AS q, unnest(['{ROUGH}', '{ZERO}']) AS s FROM customer),
gold AS (SELECT pairs.q, pairs.s, COUNT(*) AS n, COUNT(*) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM p WHERE p.q = g.q AND p.s = pairs.s AND abs(p.v - g.v) <= 0.01::DOUBLE * abs(g.v))) AS bad
  FROM pairs JOIN g ON g.q = pairs.q GROUP BY ALL),
pred AS (SELECT q, s, COUNT(*) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM g WHERE g.q = p.q AND abs(p.v - g.v) <= 0.01::DOUBLE * abs(g.v))) AS bad FROM p GROUP BY ALL)
SELECT pairs.q AS question_id, pairs.s AS strategy, coalesce(gold.n, 0) AS n_gold, coalesce(gold.bad, 0) AS n_gold_bad,
  coalesce(pred.bad, 0) AS n_pred_bad, coalesce(gold.bad, 0) = 0 AND coalesce(pred.bad, 0) = 0 AS within
FROM pairs LEFT JOIN gold USING (q, s) LEFT JOIN pred USING (q, s)""")


# --- E11: texts that are run, four for each nation ---------------------------------

_STATUSES = (
    "SELECT o_orderstatus, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total "
    "FROM run_orders JOIN run_customer ON o_custkey = c_custkey WHERE c_nationkey = {n}{more} GROUP BY o_orderstatus"
)


def nation_texts(nations: list[int]) -> list[tuple[int, str, str]]:
    """What the orders of a nation's customers come to by status: the gold text
    (every twelfth names a column that isn't there); a semi-join (every fifth
    leaves out pending orders); one with a mean (every fourth divides by zero);
    and one that is blank, a write, names no table, or is a single total."""
    texts = []
    for n in nations:
        gold = _STATUSES.format(n=n, more="")
        texts.append((n, S.GOLD, gold.replace("o_totalprice", "o_price") if n % 12 == 5 else gold))
        left_out = " AND o_orderstatus <> 'P'" if n % 5 == 1 else ""
        texts.append((n, DYNAMIC, (
            "SELECT o_orderstatus, COUNT(o_orderkey), SUM(CAST(o_totalprice AS DECIMAL(18,2))) + 0.00001 FROM run_orders "
            f"WHERE o_custkey IN (SELECT c_custkey FROM run_customer WHERE c_nationkey = {n}){left_out} GROUP BY o_orderstatus;"
        )))
        by = "(COUNT(*) - COUNT(o_orderkey))" if n % 4 == 2 else "COUNT(*)"
        texts.append((n, ZERO, gold.replace("AS n,", f"AS n, SUM(o_orderkey) DIV {by} AS mean,")))
        other = {0: "  ", 1: "DROP VIEW run_orders", 2: "SELECT COUNT(*) FROM run_nowhere"}
        texts.append((n, STATIC, other.get(n % 6, f"SELECT COUNT(*) FROM run_customer WHERE c_nationkey = {n}")))
    return texts


def s_run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over ``orders`` and ``customer``, run several at a time: whether each
    ran, how many rows it gave, why it failed, and whether it matches the gold text."""
    t = Tables(spark, sf_dir)
    t.orders.createOrReplaceTempView("run_orders")
    t.customer.createOrReplaceTempView("run_customer")
    nations = [r[0] for r in t.nation.select("n_nationkey").distinct().orderBy("n_nationkey").collect()]  # one text each, a caller's list
    got, execs = S.run_queries(spark, nation_texts(nations))
    ok = execs.filter("success").select("question_id", F.col("side").alias("strategy"))
    gold = ok.filter(F.col("strategy") == S.GOLD).select("question_id")
    pairs = ok.filter(F.col("strategy") != S.GOLD).join(gold, "question_id")
    matches = S.results_match(got, pairs).withColumnRenamed("strategy", "side")
    condition = F.regexp_extract("error", r"\[([A-Z_.]+)\]", 1)
    why = F.when(condition != "", condition).otherwise(F.col("error"))
    return execs.join(matches, ["question_id", "side"], "left").select(
        "question_id", "side", "success", "n_rows", why.alias("error"), "execution_match"
    )


register("s_run_texts", s_run_texts, f"""WITH k AS (
  SELECT n_nationkey AS q, COUNT(DISTINCT o_orderstatus) AS st, COUNT(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus <> 'P') AS st_closed
  FROM (SELECT DISTINCT n_nationkey FROM nation) LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
e AS (
  SELECT q, 'gold' AS side, st AS n, CASE WHEN q % 12 = 5 THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' END AS error, NULL AS same FROM k
  UNION ALL SELECT q, '{DYNAMIC}', CASE WHEN q % 5 = 1 THEN st_closed ELSE st END, NULL, q % 5 <> 1 OR st = st_closed FROM k
  UNION ALL SELECT q, '{ZERO}', st, CASE WHEN q % 4 = 2 AND st > 0 THEN 'DIVIDE_BY_ZERO' END, st = 0 FROM k
  UNION ALL SELECT q, '{STATIC}', 1, CASE q % 6 WHEN 0 THEN 'empty' WHEN 1 THEN '{S.REASON_WRITE}' WHEN 2 THEN 'TABLE_OR_VIEW_NOT_FOUND' END, false FROM k)
SELECT q AS question_id, side, error IS NULL AS success, CASE WHEN error IS NULL THEN n END AS n_rows, error,
  CASE WHEN error IS NULL AND q % 12 <> 5 THEN same END AS execution_match
FROM e""")

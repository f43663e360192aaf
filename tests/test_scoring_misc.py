from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from askwell.operators import scoring as S
from askwell.operators.asof import first_at_or_after
from askwell.operators.profile import ddl_text, foreign_key_profile, key_profile, schema_fields
from askwell.operators.ranking import global_prefix_sums, global_rank


def _rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_results_match_cases(spark):
    sch = "a long, b double, c string"
    gold = {
        1: [(1, 1.0, "x"), (2, 2.0, "y")],
        2: [(1, 1.0, "x"), (1, 1.0, "x"), (2, 2.0, None)],
        3: [(1, 1.23456, "x")],
        4: [],
        5: [(1, 1.0, "x")],
    }
    pred = {
        1: [(2, 2.0, "y"), (1, 1.0, "x")],              # reordered rows -> match
        2: [(1, 1.0, "x"), (2, 2.0, None), (2, 2.0, None)],  # duplicate counts differ -> no
        3: [(1, 1.23459, "x")],                          # differs at the 5th decimal -> match at 4 dp? no
        4: [],                                           # both empty -> match
        5: [(1, 1.0, "x")],
    }
    parts = []
    for q, rows in gold.items():
        parts.append(S.result_rows(_rows(spark, rows, sch), q, S.GOLD))
    for q, rows in pred.items():
        if q == 5:
            parts.append(S.result_rows(_rows(spark, [(1, 1.0, "x", 9)], sch + ", d long"), q, "s"))  # extra column
        else:
            parts.append(S.result_rows(_rows(spark, rows, sch), q, "s"))
    allr = parts[0]
    for p in parts[1:]:
        allr = allr.unionByName(p)
    pairs = spark.createDataFrame([(q, "s") for q in gold], "question_id long, strategy string")
    got = {r["question_id"]: r["execution_match"] for r in S.results_match(allr, pairs).collect()}
    # 1.23456 -> 1.2346 and 1.23459 -> 1.2346: equal after rounding to 4 dp
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_score_examples_order_of_checks(spark):
    questions = _rows(spark, [(1, "simple", "SELECT 1"), (2, "moderate", "SELECT 2"), (3, "hard", "SELECT 3"), (4, None, "select  3 ;")],
                      "question_id long, difficulty string, gold_sql string")
    preds = _rows(spark, [("s", 1, "  "), ("s", 2, "SELECT 2"), ("s", 3, "SELECT x"), ("s", 4, "SELECT 3")],
                  "strategy string, question_id long, generated_sql string")
    execs = _rows(spark, [(1, "gold", True), (2, "gold", False), (3, "gold", True), (3, "s", False), (4, "gold", True), (4, "s", True), (2, "s", True)],
                  "question_id long, side string, success boolean")
    matches = _rows(spark, [(4, "s", True), (2, "s", True)], "question_id long, strategy string, execution_match boolean")
    got = {r["question_id"]: r for r in S.score_examples(questions, preds, execs, matches).collect()}
    assert (got[1]["error"], got[1]["exact_match"], got[1]["valid_sql"]) == (S.ERR_EMPTY, False, False)
    assert (got[2]["error"], got[2]["exact_match"], got[2]["execution_match"]) == (S.ERR_GOLD, True, False)
    assert (got[3]["error"], got[3]["valid_sql"]) == (S.ERR_PRED, False)
    assert (got[4]["error"], got[4]["valid_sql"], got[4]["execution_match"], got[4]["difficulty"]) == (None, True, True, "unknown")
    # "select  3 ;" normalises to "select 3 " (space kept before ';', as in the reference)
    assert got[4]["exact_match"] is False


def test_summary_leaderboard_and_running(spark):
    scored = _rows(spark, [("a", i, "simple", i % 3 == 0, True, False) for i in range(1, 26)]
                   + [("b", i, "hard", True, True, True) for i in range(1, 26)],
                   "strategy string, question_id long, difficulty string, execution_match boolean, valid_sql boolean, exact_match boolean")
    summ = {r["strategy"]: r for r in S.strategy_summary(scored).collect()}
    assert summ["a"]["execution_accuracy"] == Decimal("0.3200") and summ["b"]["exact_match_rate"] == Decimal("1.0000")
    lb = S.strategy_leaderboard(S.strategy_summary(scored)).collect()
    assert [r["strategy"] for r in lb] == ["b", "a"] and lb[0]["is_best"] and not lb[1]["is_best"]
    run = {(r["strategy"], r["i"]): r["running_accuracy"] for r in S.running_accuracy(scored).collect()}
    assert set(run) == {("a", 10), ("a", 20), ("a", 25), ("b", 10), ("b", 20), ("b", 25)}
    assert run[("a", 10)] == Decimal("0.3000") and run[("a", 25)] == Decimal("0.3200")


def test_phases(spark):
    pr = _rows(spark, [("baseline", 1, "simple", "correct", True), ("baseline", 2, "moderate", "incorrect", True),
                       ("with_learning", 1, "simple", "incorrect", True), ("with_learning", 2, "moderate", "correct", False),
                       ("baseline", 3, "moderate", "incorrect", True), ("with_learning", 3, "moderate", "correct", True)],
               "phase string, question_id long, difficulty string, verdict string, valid_sql boolean")
    acc = {r["phase"]: r for r in S.phase_accuracy(pr).collect()}
    assert acc["baseline"]["accuracy"] == Decimal("0.3333") and acc["with_learning"]["accuracy"] == Decimal("0.6667")
    assert acc["baseline"]["improvement_pp"] == Decimal("33.3")
    fl = {r["question_id"]: r["flip"] for r in S.flips(pr).collect()}
    assert fl == {1: "regressed", 2: "fixed", 3: "fixed"}
    cmp_ = [tuple(r) for r in S.phase_comparison(pr).collect()]
    assert cmp_[0][0] == "simple" and cmp_[2] == ("challenging", 0, Decimal("0.0000"), Decimal("0.0000"), Decimal("0.0"))
    assert cmp_[1][4] == Decimal("100.0")
    v = _rows(spark, [(True, True, " equivalent: yes"), (False, True, "EQUIVALENT"), (True, True, "DIFFERENT")],
              "p boolean, g boolean, j string")
    assert [r[0] for r in v.select(S.phase_verdict(F.col("p"), F.col("g"), F.col("j"))).collect()] == ["correct", "incorrect", "incorrect"]


def test_answers_within_1pct_and_preview(spark):
    g = _rows(spark, [("x", 100.0), ("y", 50.0)], "k string, v double")
    p = _rows(spark, [("x", 100.9), ("y", 50.0)], "k string, v double")
    assert S.answers_within_1pct(g, p, ["k"], ["v"]).collect()[0]["match"]
    p2 = _rows(spark, [("x", 102.0)], "k string, v double")
    assert not S.answers_within_1pct(g, p2, ["k"], ["v"]).collect()[0]["match"]
    rows = S.result_rows(_rows(spark, [(i,) for i in range(30)], "a long"), 1, S.GOLD)
    pv = S.preview_rows(rows, 25).collect()[0]
    assert len(pv["shown"]) == 25 and pv["n_more"] == 5


def test_global_rank_and_prefix_sums(spark):
    rnd = random.Random(5)
    data = [(i, rnd.randrange(0, 20)) for i in range(300)]
    df = _rows(spark, data, "id long, v long")
    got = {r["id"]: r["rank"] for r in global_rank(df, [F.desc("v")], "rank", num_partitions=7).collect()}
    want = {r["id"]: r["r"] for r in df.select("id", F.rank().over(Window.orderBy(F.desc("v"))).alias("r")).collect()}
    assert got == want
    g = _rows(spark, [(k, i, i % 2) for k in ("a", "b") for i in range(1, 101)], "g string, i long, x long")
    ps = {(r["g"], r["i"]): (r["_i"], r["x_cum"]) for r in global_prefix_sums(g, ["g"], ["i"], ["x"], 6).collect()}
    assert ps[("a", 100)] == (100, 50) and ps[("b", 7)] == (7, 4)


def test_asof_equals_brute_force(spark):
    rnd = random.Random(9)
    base = dt.datetime(2024, 1, 1)
    left = [(i, rnd.randrange(3), base + dt.timedelta(minutes=rnd.randrange(0, 3000))) for i in range(120)]
    right = [(1000 + i, rnd.randrange(3), base + dt.timedelta(minutes=rnd.randrange(0, 3000)), float(i)) for i in range(80)]
    L = _rows(spark, left, "lid long, k long, ts timestamp")
    R = _rows(spark, right, "rid long, k long, ts timestamp, val double")
    horizon = 600 * 60
    got = {r["lid"]: r["rid"] for r in first_at_or_after(
        L, R, key="k", left_id="lid", left_ts="ts", right_id="rid", right_ts="ts", right_value="val",
        horizon_seconds=horizon, bucket_seconds=3600).collect()}
    want = {}
    for lid, k, ts in left:
        c = [(rts, rid) for rid, rk, rts, _ in right if rk == k and ts <= rts <= ts + dt.timedelta(seconds=horizon)]
        if c:
            want[lid] = min(c)[1]
    assert got == want


def test_profiles(spark):
    assert ddl_text("t", [("a", "bigint"), ("b", "string")], ["a"], [("b", "u", "x")]) == (
        "CREATE TABLE t (\n  a BIGINT,\n  b STRING,\n  PRIMARY KEY (a),\n  FOREIGN KEY (b) REFERENCES u(x)\n);"
    )
    t = _rows(spark, [(1, 1), (2, 1), (3, None)], "id long, p long")
    u = _rows(spark, [(1,)], "x long")
    kp = {r["column_name"]: r["is_key"] for r in key_profile({"t": t}, {"t": ["id", "p"]}).collect()}
    assert kp == {"id": True, "p": False}
    fk = foreign_key_profile({"t": t, "u": u}, [("t", "p", "u", "x")]).collect()[0]
    assert fk["holds"] and fk["orphans"] == 0


def test_special_numbers_and_nulls_are_different_cells(spark):
    df = spark.sql("SELECT double('NaN') a UNION ALL SELECT double('Infinity') UNION ALL SELECT double('-Infinity') UNION ALL SELECT 1e40D UNION ALL SELECT NULL UNION ALL SELECT 15.00004D")
    got = [r["row"][0] for r in S.result_rows(df, 1, S.GOLD).collect()]
    assert got == ["NaN", "Infinity", "-Infinity", "1.0E40", None, "15.0000"]
    rows = S.result_rows(spark.sql("SELECT string(NULL) x"), 1, S.GOLD).unionByName(S.result_rows(spark.sql("SELECT '\\\\N' x"), 1, "a"))
    rows = rows.unionByName(S.result_rows(spark.sql("SELECT string(NULL) x"), 1, "b"))
    pairs = _rows(spark, [(1, "a"), (1, "b")], "question_id long, strategy string")
    assert {r["strategy"]: r["execution_match"] for r in S.results_match(rows, pairs).collect()} == {"a": False, "b": True}


def test_run_time_failure_is_a_recorded_outcome(spark):
    texts = [(1, S.GOLD, "SELECT id FROM range(3)"), (1, "a", "SELECT raise_error('no') AS id FROM range(3)"), (2, "a", "SELECT nothing FROM nowhere")]
    rows, execs = S.run_queries(spark, texts)
    assert rows.count() == 3
    assert {(r["question_id"], r["side"]): r["success"] for r in execs.collect()} == {(1, S.GOLD): True, (1, "a"): False, (2, "a"): False}


def test_ddl_states_constraints_of_the_schema():
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([
        StructField("a", LongType(), False), StructField("b", StringType(), True, {"CURRENT_DEFAULT": "'x'"}),
    ])
    assert ddl_text("t", schema_fields(schema)) == "CREATE TABLE t (\n  a BIGINT NOT NULL,\n  b STRING DEFAULT 'x'\n);"


def test_lenient_match_cuts_to_the_gold_columns(spark):
    gold = S.named_rows(_rows(spark, [(1, "a", 1.001), (1, "a", 1.001), (2, "b", None), (3, "c", 3.0)], "q long, k string, v double"), "q", S.GOLD)
    wide = S.named_rows(
        _rows(spark, [(1, 1.0, "a", 7), (1, 1.0, "a", 8), (2, None, "b", 9), (3, 3.02, "c", 1), (5, 1.0, "x", 1)], "q long, v double, k string, extra int"), "q", "wide")
    short = S.named_rows(_rows(spark, [(1, "a"), (1, "a"), (2, "b")], "q long, k string"), "q", "short")
    pairs = _rows(spark, [(q, s) for q in (1, 2, 3, 4, 5) for s in ("wide", "short")], "question_id long, strategy string")
    got = {(r[0], r[1]): r[2] for r in S.lenient_match(gold.unionByName(wide).unionByName(short), pairs).collect()}
    assert got == {(1, "wide"): True, (2, "wide"): True, (3, "wide"): False, (4, "wide"): True, (5, "wide"): False,
                   (1, "short"): False, (2, "short"): False, (3, "short"): False, (4, "short"): True, (5, "short"): True}


def test_within_1pct_equals_brute_force(spark):
    import random

    rnd = random.Random(5)
    gold, pred = [], []
    for q in range(60):
        for _ in range(rnd.randrange(4)):
            v = rnd.choice([0.0, 100.0, -5.0, 1e-9, rnd.uniform(-1e6, 1e6)])
            gold.append((q, v))
            pred.append((q, "a", v * rnd.choice([1.0, 1.01, 0.99, 0.9899, 1.0101, 1.005, -1.0])))
            if rnd.random() < 0.2:
                pred.append((q, "b", v + 1.0))
    gold.append((3, None))
    pairs = [(q, s) for q in range(60) for s in "ab"]
    got = S.within_1pct(
        _rows(spark, gold, "question_id long, value double"), _rows(spark, pred, "question_id long, strategy string, value double"),
        _rows(spark, pairs, "question_id long, strategy string"))
    for r in got.collect():
        g = {v for q, v in gold if q == r["question_id"] and v is not None}
        p = {v for q, s, v in pred if (q, s) == (r["question_id"], r["strategy"])}
        bad = sum(not any(abs(y - x) <= 0.01 * abs(x) for y in p) for x in g)
        extra = sum(not any(abs(y - x) <= 0.01 * abs(x) for x in g) for y in p)
        assert (r["n_gold"], r["n_gold_bad"], r["n_pred_bad"], r["within"]) == (len(g), bad, extra, bad + extra == 0)


def test_texts_run_at_once_and_late_ones_are_cancelled(spark):
    import time

    slow = "SELECT COUNT(*) AS n FROM range(0, 1000000000000, 1, 2) WHERE hash(id, id * 3) = 1"
    texts = [(q, S.GOLD, f"SELECT id FROM range({q})") for q in range(6)]
    texts += [(10, "a", slow), (11, "a", "  "), (12, "a", "DELETE FROM t"), (13, "a", "SELECT 1 DIV (id - id) AS x FROM range(2)")]
    start = time.time()
    rows, execs = S.run_queries(spark, texts, timeout_s=15, at_once=4)
    assert time.time() - start < 90
    got = {r["question_id"]: r for r in execs.collect()}
    assert {q: (got[q]["success"], got[q]["n_rows"]) for q in range(6)} == {q: (True, q) for q in range(6)}
    assert got[10]["error"] == "timed out after 15 s" and got[11]["error"] == "empty"
    assert got[12]["error"] == S.REASON_WRITE and "DIVIDE_BY_ZERO" in got[13]["error"]
    assert got[13]["n_rows"] is None and rows.count() == sum(range(6))
    # the caller's thread keeps no tag or pool of the texts
    assert not spark.sparkContext.getJobTags() and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_a_text_may_stand_once(spark):
    import pytest

    with pytest.raises(ValueError):
        S.run_queries(spark, [(1, "a", "SELECT 1"), (1, "a", "SELECT 2")])
    rows, execs = S.run_queries(spark, [])
    assert rows.count() == 0 and execs.count() == 0


def test_scoring_joins_are_never_broadcast(spark):
    """One row per question or pair is as large as the question set; small
    estimates (here tiny tables) must not make the driver build broadcasts of it."""
    questions = _rows(spark, [(1, "simple", "SELECT 1"), (2, None, "SELECT 2")], "question_id long, difficulty string, gold_sql string")
    preds = _rows(spark, [("s", 1, "SELECT 1"), ("s", 2, "SELECT 3")], "strategy string, question_id long, generated_sql string")
    execs = _rows(spark, [(q, side, True) for q in (1, 2) for side in ("gold", "s")], "question_id long, side string, success boolean")
    rows = _rows(spark, [(1, "gold", ["1"]), (1, "s", ["1"]), (2, "gold", ["2"]), (2, "s", ["3"])], "question_id long, side string, row array<string>")
    scored = S.score_examples(questions, preds, execs, S.results_match(rows, preds.select("question_id", "strategy")))
    got = {r["question_id"]: r["execution_match"] for r in scored.collect()}
    assert got == {1: True, 2: False}
    assert "BroadcastExchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_results_match_counts_rows_without_a_full_join(spark):
    """one aggregation of signed counts instead of a sorted full join; repeated
    pairs, a result that one side lacks and a row that is NULL as before."""
    rows = _rows(spark, [(1, "gold", ["a", None]), (1, "gold", ["a", None]), (1, "s", ["a", None]), (1, "t", ["a", None]), (1, "t", ["a", None]),
                         (2, "gold", ["x"]), (3, "s", ["x"]), (4, "gold", None), (4, "s", None), (5, "u", ["x"])],
                 "question_id long, side string, row array<string>")
    pairs = _rows(spark, [(1, "s"), (1, "t"), (1, "t"), (2, "s"), (3, "s"), (4, "s"), (5, "s"), (None, "s")], "question_id long, strategy string")
    out = S.results_match(rows, pairs)
    got = sorted((r["question_id"] or 0, r["strategy"], r["execution_match"]) for r in out.collect())
    assert got == [(0, "s", True), (1, "s", False), (1, "t", True), (1, "t", True), (2, "s", False), (3, "s", False), (4, "s", False), (5, "s", True)]
    assert "FullOuter" not in out._jdf.queryExecution().executedPlan().toString()

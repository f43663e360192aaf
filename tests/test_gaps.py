from __future__ import annotations

from askwell.operators import feedback as FB
from askwell.operators import memory as M
from askwell.operators.profile import table_allow_list


def test_table_allow_list(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("orders_t")
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("langchain_pg_embedding")
    names = [r[0] for r in table_allow_list(spark).collect()]
    assert "orders_t" in names and "langchain_pg_embedding" not in names
    assert [r[0] for r in table_allow_list(spark, ["orders_t"]).collect()] == ["orders_t"]
    assert table_allow_list(spark, []).count() == 0


def test_manual_add(spark):
    spark.createDataFrame([(1, "x")], "id int, v string").createOrReplaceTempView("manual_t")
    cands = spark.createDataFrame(
        [("count rows of manual t", "SELECT COUNT(*) FROM manual_t"),
         ("bad table question", "SELECT * FROM no_such_table"),
         ("drop it", "DROP TABLE manual_t"),
         ("count rows of manual t", "SELECT 1 FROM manual_t"),
         ("already stored question text", "SELECT v FROM manual_t")],
        "question string, sql_query string",
    )
    store = spark.createDataFrame([("already stored question text",)], "question string")
    out = {r["seq"]: (r["added"], r["message"]) for r in FB.manual_add(spark, cands, store).collect()}
    assert out[1] == (True, "Example added to behavioral memory.")
    assert out[2][0] is False and out[2][1].startswith("Validation failed: EXPLAIN failed")
    assert out[3] == (False, "Validation failed: " + FB.REASON_WRITE)
    assert out[4] == (False, "Example too similar to existing entry (duplicate).")
    assert out[5] == (False, "Example too similar to existing entry (duplicate).")


def test_select_dynamic_feedback(spark):
    e = lambda *v: [float(x) for x in v]
    seed = spark.createDataFrame([("s1", "seed q", "SELECT 0", e(1, 0, 0))],
                                 "example_id string, question string, sql_query string, embedding array<double>")
    qs = spark.createDataFrame(
        [(10, 0, "q0", "SELECT 10", True, e(0, 1, 0)),
         (11, 1, "q1", "SELECT 11", False, e(0, 0, 1)),
         (12, 2, "q2", "SELECT 12", True, e(0, 1, 0.01)),   # duplicate of q0 once q0 is learned
         (13, 3, "q3", "SELECT 13", True, e(0, 1, 0.1))],
        "q_id long, seq long, question string, gold_sql string, correct boolean, embedding array<double>",
    )
    got = {r["q_id"]: [x["sql_query"] for x in r["examples"]] for r in M.select_dynamic_feedback(qs, seed, k=2).collect()}
    assert got[10] == ["SELECT 0"]                     # only the seed exists before q0
    assert got[11][0] in ("SELECT 0", "SELECT 10")      # q0 was learned (seq 0 < 1)
    assert "SELECT 10" in got[13] and "SELECT 12" not in got[13]  # q2 was a duplicate, never stored

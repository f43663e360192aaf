from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from askwell.operators import feedback as FB
from askwell.operators import memory as M


def test_budget_select_equals_sequential_loop(spark):
    rnd = random.Random(11)
    cands, qs, want = [], [], {}
    for q in range(40):
        qtok = rnd.randrange(0, 3000)
        qs.append((q, " ".join(["w"] * qtok)))
        costs = [rnd.randrange(10, 900) for _ in range(6)]
        for r, c in enumerate(costs, start=1):
            cands.append((q, r, 100 * q + r, c))
        remaining = 3500 - 500 - 0 - qtok
        chosen = []
        if remaining > 0:
            for r, c in enumerate(costs, start=1):
                if c > remaining:
                    break
                chosen.append(r)
                remaining -= c
                if len(chosen) >= 3:
                    break
        want[q] = chosen
    cdf = spark.createDataFrame(cands, "q_id long, rank long, s_id long, cost int")
    qdf = spark.createDataFrame(qs, "q_id long, question string")
    got = {}
    for r in M.budget_select(cdf, qdf).collect():
        got.setdefault(r["q_id"], []).append(r["rank"])
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


def _py_prompt(question, examples, schema):
    parts = []
    if examples:
        blocks = [f"Question: {q}\nSQL:\n{s}\n" for q, s in examples]
        parts.append(M.BEHAVIORAL_HEAD + "\n".join(blocks) + "\n")
    if schema:
        parts.append(schema)
    parts.append(M.EXECUTIVE_HEAD + question + M.EXECUTIVE_TAIL)
    return "\n".join(parts)


def test_build_prompts_layout(spark):
    qs = spark.createDataFrame([(1, "How many?"), (2, "Top 3?")], "q_id long, question string")
    ex = spark.createDataFrame(
        [(1, [("q a", "SELECT 1"), ("q b", "SELECT 2")])],
        "q_id long, examples array<struct<question:string,sql_query:string>>",
    )
    schema = M.schema_section([("orders", 13, "CREATE TABLE orders (\n  id INT\n);"), ("t", None, "CREATE TABLE t (\n  x INT\n);")])
    rows = {r["q_id"]: r for r in M.build_prompts(qs, ex, schema).collect()}
    assert rows[1]["user"] == _py_prompt("How many?", [("q a", "SELECT 1"), ("q b", "SELECT 2")], schema)
    assert rows[2]["user"] == _py_prompt("Top 3?", [], schema)
    assert rows[1]["n_examples"] == 2 and rows[2]["n_examples"] == 0
    assert "(13 rows)" in schema and "(? rows)" in schema
    assert rows[1]["system"] == M.SYSTEM_PROMPT


def test_select_strategies(spark):
    qs = spark.createDataFrame([(i, f"q{i}") for i in range(20)], "q_id long, question string")
    pool = spark.createDataFrame([(i, f"pq{i}", f"SELECT {i}") for i in range(10)], "example_id long, question string, sql_query string")
    zero = M.select_zero(qs).collect()
    assert all(len(r["examples"]) == 0 for r in zero)
    static = M.select_static(qs, pool, 3).collect()
    assert all([e["sql_query"] for e in r["examples"]] == ["SELECT 0", "SELECT 1", "SELECT 2"] for r in static)
    a = {r["q_id"]: [e["sql_query"] for e in r["examples"]] for r in M.select_random(qs, pool, 3).collect()}
    b = {r["q_id"]: [e["sql_query"] for e in r["examples"]] for r in M.select_random(qs.repartition(7), pool, 3).collect()}
    assert a == b
    assert all(len(set(v)) == 3 for v in a.values())
    small = pool.limit(2)
    assert all(len(r["examples"]) == 2 for r in M.select_random(qs, small, 3).collect())


def test_random_draws_from_a_large_pool_evenly(spark):
    pool = spark.range(1_001).select(
        F.col("id").alias("example_id"), F.col("id").cast("string").alias("question"),
        F.col("id").cast("string").alias("sql_query"),
    )
    qs = spark.range(3_000).select(F.col("id").alias("q_id"))
    rows = M.select_random(qs, pool, 5).collect()
    drawn = [int(e["question"]) for r in rows for e in r["examples"]]
    assert len(rows) == 3_000 and all(len({e["question"] for e in r["examples"]}) == 5 for r in rows)
    by_tenth = [sum(d * 10 // 1_001 == t for d in drawn) for t in range(10)]
    assert all(1_300 < n < 1_700 for n in by_tenth)  # 1,500 expected
    assert all(r["examples"] == [] for r in M.select_random(qs, pool.limit(0), 5).collect())


def test_analysis_writes_chunks_and_has_no_cap(spark):
    texts = spark.createDataFrame(
        [(f"SELECT {i}",) for i in range(7)] + [("SELECT x FROM no_such_table",), ("DROP TABLE a",), ("  ",), ("SELECT 1",)],
        "generated_sql string",
    )
    got = {r[0]: r[1] for r in FB.analysable_texts(spark, texts, chunk=3).collect()}
    assert got == {**{f"SELECT {i}": True for i in range(7)}, "SELECT x FROM no_such_table": False}


def _ts(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def test_first_positive_cases(spark):
    traces = spark.createDataFrame(
        [
            ("t1", _ts(0), ["question-answering"], "in1", ("Q1", "SELECT 1")),
            ("t2", _ts(1), ["question-answering"], "in2", ("Q2", "SELECT 2")),
            ("t3", _ts(2), ["question-answering"], "in3", ("Q3", "SELECT 3")),
            ("t4", _ts(3), ["question-answering"], "in4", ("Q4", "SELECT 4")),
            ("t5", _ts(4), ["question-answering"], "fallback question", (None, "SELECT 5")),
            ("t6", _ts(5), ["question-answering"], "in6", ("Q6", "SELECT 6")),
        ],
        "trace_id string, ts timestamp, tags array<string>, input string, metadata struct<question:string, generated_sql:string>",
    )
    scores = spark.createDataFrame(
        [
            ("t2", _ts(10), "quality", None, ""),        # null value
            ("t3", _ts(10), "quality", 0.5, ""),         # below threshold
            ("t4", _ts(10), "helpfulness", 1.0, ""),     # wrong name
            ("t5", _ts(10), "quality", 1.0, "ok"),       # question falls back to input
            ("t6", _ts(12), "quality", 2.0, "second"),   # two qualifying: the first wins
            ("t6", _ts(11), "quality", 1.0, "first"),
        ],
        "trace_id string, ts timestamp, name string, value double, comment string",
    )
    got = {r["trace_id"]: r for r in FB.first_positive(traces, scores).collect()}
    assert set(got) == {"t5", "t6"}  # t1 has no score
    assert got["t5"]["question"] == "fallback question"
    assert got["t6"]["score_comment"] == "first" and got["t6"]["score_value"] == 1.0


def test_process_feedback_gates(spark):
    rows = [
        ("a", 0, "How many orders are there?", "SELECT COUNT(*) FROM orders"),
        ("b", 1, "", "SELECT 1"),                                   # missing question: skipped
        ("c", 2, "Drop the table please", "DROP TABLE orders"),     # write keyword
        ("d", 3, "Blank sql question", "   "),                      # blank SQL -> rejected by validation
        ("e", 4, "How many orders are there?", "SELECT COUNT(1) FROM orders"),  # copy of a's question
        ("f", 5, "revenue by category for every category", "SELECT 2"),  # duplicate of the store
        ("g", 6, "alpha beta gamma delta", "SELECT 3"),              # A
        ("h", 7, "alpha beta gamma delta epsilon zeta", "SELECT 4"), # B ~ A and C
        ("i", 8, "beta gamma delta epsilon zeta eta theta", "SELECT 5"),  # C ~ B, C !~ A
    ]
    traces = spark.createDataFrame(
        [(t, _ts(m), ["question-answering"], q, (q, s)) for t, m, q, s in rows],
        "trace_id string, ts timestamp, tags array<string>, input string, metadata struct<question:string, generated_sql:string>",
    ).withColumn("input", F.lit(None).cast("string"))
    scores = spark.createDataFrame([(t, _ts(100), "quality", 1.0, "") for t, *_ in rows],
                                   "trace_id string, ts timestamp, name string, value double, comment string")
    store = spark.createDataFrame([("revenue by category for every category",)], "question string")
    out = {r["trace_id"]: r["status"] for r in FB.process_feedback(traces, scores, store, threshold=0.7).collect()}
    assert out["a"] == FB.APPROVED
    assert out["b"] == FB.SKIPPED
    assert out["c"] == FB.REJ_VALID
    assert out["d"] == FB.REJ_VALID
    assert out["e"] == FB.REJ_DUP
    assert out["f"] == FB.REJ_DUP
    assert (out["g"], out["h"], out["i"]) == (FB.APPROVED, FB.REJ_DUP, FB.APPROVED)
    stats = FB.gate_stats(FB.process_feedback(traces, scores, store, threshold=0.7)).collect()[0]
    assert stats.asDict() == {"approved": 3, "rejected_validation": 2, "rejected_duplicate": 3, "skipped": 1}


def test_read_traces_since_and_limit(spark):
    traces = spark.createDataFrame(
        [(f"t{i}", _ts(i), ["question-answering"] if i % 2 == 0 else ["other"]) for i in range(10)],
        "trace_id string, ts timestamp, tags array<string>",
    )
    got = [r["trace_id"] for r in FB.read_traces(traces, since=_ts(3), limit=2).collect()]
    assert got == ["t8", "t6"]

from __future__ import annotations

import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from askwell.operators import feedback as FB
from askwell.sources import io as IO
from askwell.streaming import feedback_stream as ST

TRACE_SCHEMA = (
    "trace_id string, ts timestamp, tags array<string>, input string, "
    "metadata struct<question:string, generated_sql:string>"
)
SCORE_SCHEMA = "trace_id string, ts timestamp, name string, value double, comment string"

QUESTIONS = [
    "How many orders are there?",
    "How many orders are there in total?",
    "revenue by product category",
    "alpha beta gamma delta",
    "alpha beta gamma delta epsilon zeta",
    "beta gamma delta epsilon zeta eta theta",
    "Drop everything",
    "monthly revenue in 2025",
    "How many orders are there?",
    "average basket size per segment",
]


def _batches():
    base = dt.datetime(2024, 1, 1)
    tr, sc = [], []
    for i, q in enumerate(QUESTIONS):
        sql = "DROP TABLE t" if q.startswith("Drop") else f"SELECT {i}"
        ts = base + dt.timedelta(minutes=10 * i)
        tr.append((f"t{i}", ts, ["question-answering"], q, (q, sql)))
        sc.append((f"t{i}", ts + dt.timedelta(minutes=1), "quality", 1.0, ""))
        if i == 3:
            sc.append((f"t{i}", ts + dt.timedelta(minutes=2), "quality", 5.0, "later"))
    return tr, sc


def test_stream_replay_equals_batch(spark):
    tr, sc = _batches()
    traces = spark.createDataFrame(tr, TRACE_SCHEMA)
    scores = spark.createDataFrame(sc, SCORE_SCHEMA)
    store0 = spark.createDataFrame([("revenue by product category",)], "question string")
    batch = FB.process_feedback(traces, scores, store0, threshold=0.7)
    want = {r["trace_id"] for r in batch.filter(F.col("status") == FB.APPROVED).collect()}

    root = tempfile.mkdtemp(prefix="askwell-stream-", dir="/tmp")
    tdir, sdir, store = f"{root}/traces", f"{root}/scores", f"{root}/store"
    # seed the store (batch -1) with the initial example
    IO.append_examples(store0.select(F.lit("seed").alias("example_id"), "question"), store, -1)
    # three micro-batches in arrival order: one trace file and one score file each
    cuts = [(0, 4), (4, 7), (7, 10)]
    for n, (a, b) in enumerate(cuts):
        spark.createDataFrame(tr[a:b], TRACE_SCHEMA).coalesce(1).write.parquet(f"{tdir}/part{n}")
        spark.createDataFrame([s for s in sc if int(s[0][1:]) in range(a, b)], SCORE_SCHEMA).coalesce(1).write.parquet(
            f"{sdir}/part{n}")
    t_stream = spark.readStream.schema(TRACE_SCHEMA).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(tdir)
    s_stream = spark.readStream.schema(SCORE_SCHEMA).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(sdir)
    q = ST.start_feedback_stream(
        spark, t_stream, s_stream, store, stats_path=f"{root}/stats", checkpoint=f"{root}/ckpt",
        available_now=True, threshold=0.7,
    )
    q.awaitTermination(300)
    got = {r["trace_id"] for r in IO.read_store(spark, store).filter(F.col("trace_id").isNotNull()).collect()}
    assert got == want
    assert want == {"t0", "t3", "t5", "t7", "t9"}
    stats = spark.read.parquet(f"{root}/stats").agg(F.sum("approved"), F.sum("rejected_validation")).collect()[0]
    assert tuple(stats) == (5, 1)


def _streams(spark, root, trace_parts, score_parts):
    """File streams of one file a micro-batch."""
    for name, parts, schema in (("traces", trace_parts, TRACE_SCHEMA), ("scores", score_parts, SCORE_SCHEMA)):
        for n, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}/part{n}")
    return [
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/{name}")
        for name, schema in (("traces", TRACE_SCHEMA), ("scores", SCORE_SCHEMA))
    ]


def test_keyed_state_equals_the_batch_join(spark):
    """Late, repeated and out-of-order scores: settled records are those of J6."""
    base = dt.datetime(2024, 1, 1)

    def score(k, minutes, value=1.0, comment="", name="quality"):
        return (f"t{k}", base + dt.timedelta(minutes=minutes), name, value, comment)

    traces = [(f"t{k}", base + dt.timedelta(minutes=k), [], "in", (f"q{k}", f"SELECT {k}")) for k in range(6)]
    parts = [
        [score(0, 50, comment="second"), score(1, 20), score(1, 20), score(2, 30, 0.0)],
        [score(0, 40, comment="first"), score(0, 40, comment="later comment"), score(1, 10, comment="earlier"), score(3, 60, 2.0)],
        [score(3, 60, 1.5), score(2, 90), score(5, 20, name="other"), score(0, 45)],
        # watermarks move on: all that is held settles
        [("far", base + dt.timedelta(days=40), "quality", 1.0, "")],
        [("far", base + dt.timedelta(days=41), "quality", 1.0, "")],
    ]
    far = [("far", base + dt.timedelta(days=39 + k), [], "", ("", "")) for k in range(2)]
    seen = ("t4", base, "quality", 1.0, "")
    parts[1].append(("t4", base + dt.timedelta(minutes=30), "quality", 1.0, "known to the store"))
    assert seen
    root = tempfile.mkdtemp(prefix="askwell-state-", dir="/tmp")
    t, s = _streams(spark, root, [traces, [], [], far[:1], far[1:]], parts)
    store = spark.createDataFrame([("t4", dt.datetime(2024, 1, 1)), (None, None)], "trace_id string, created_at timestamp")
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            assert r["trace_id"] not in got  # handed on once
            got[r["trace_id"]] = (r["ts"], r["question"], r["generated_sql"], r["score_value"], r["score_comment"])

    first = ST.first_positive_stream(ST.positive_stream(t, s), store, settle=True)
    q = first.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination(300)
    batch = FB.first_positive(spark.createDataFrame(traces, TRACE_SCHEMA), spark.createDataFrame([x for p in parts for x in p], SCORE_SCHEMA))
    want = {
        r["trace_id"]: (r["ts"], r["question"], r["generated_sql"], r["score_value"], r["score_comment"])
        for r in batch.collect() if r["trace_id"] != "t4"
    }
    got.pop("far", None)
    assert got == want and set(want) == {"t0", "t1", "t2", "t3"}
    assert want["t0"][4] == "first" and want["t1"][4] == "earlier"


def test_supervised_loop_goes_on_after_an_error(spark):
    """The second micro-batch fails once: noted, repeated from the checkpoint, then done."""
    tr, sc = _batches()
    tr.append(("t10", tr[-1][1], [], "", ("unknown table", "SELECT x FROM no_such_table")))
    sc.append(("t10", sc[-1][1], "quality", 1.0, ""))
    root = tempfile.mkdtemp(prefix="askwell-loop-", dir="/tmp")
    store = f"{root}/store"
    IO.append_examples(spark.createDataFrame([("seed", "revenue by product category")], "example_id string, question string"), store, -1)
    t, s = _streams(spark, root, [tr[:4], tr[4:]], [sc[:5], sc[5:]])
    body = ST.make_batch_handler(spark, store, f"{root}/stats", threshold=0.7, analyse=True)
    calls = []

    def flaky(batch, batch_id):
        calls.append(batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("the store was away")
        body(batch, batch_id)

    def start():
        return ST.start_feedback_stream(
            spark, t, s, store, stats_path=f"{root}/stats", checkpoint=f"{root}/ckpt", available_now=True, handler=flaky
        )

    report = ST.supervise(spark, start, pause_seconds=0.1)
    assert report.restarts == 1 and len(report.errors) == 1 and calls.count(1) == 2
    got = {r["trace_id"] for r in IO.read_store(spark, store).filter(F.col("trace_id").isNotNull()).collect()}
    assert got == {"t0", "t3", "t5", "t7", "t9"}
    stats = spark.read.parquet(f"{root}/stats").agg(F.sum("approved"), F.sum("rejected_validation")).first()
    assert tuple(stats) == (5, 2)  # the write and the unknown table


def test_supervised_loop_is_bounded(spark):
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    root = tempfile.mkdtemp(prefix="askwell-bound-", dir="/tmp")

    def start():
        return rate.writeStream.foreachBatch(lambda b, i: None).option("checkpointLocation", f"{root}/ckpt").start()

    report = ST.supervise(spark, start, max_batches=3)
    assert report.batches >= 3 and report.errors == []

    def failing():
        def fail(b, i):
            raise ValueError("never works")

        return rate.writeStream.foreachBatch(fail).option("checkpointLocation", f"{root}/ckpt2").start()

    with pytest.raises(Exception, match="never works"):
        ST.supervise(spark, failing, max_restarts=1, pause_seconds=0.1)


def test_load_questions_fallbacks(spark):
    d = tempfile.mkdtemp(prefix="askwell-json-", dir="/tmp")
    items = [
        {"question": "q0", "SQL": "SELECT 0", "db_id": "a", "difficulty": "simple", "question_id": 7},
        {"question": "q1", "sql": "SELECT 1", "db_id": "b"},
        {"question": "q2", "query": "SELECT 2", "db_id": "a", "evidence": "hint"},
    ]
    with open(f"{d}/mini_dev.json", "w") as f:
        json.dump(items, f, indent=2)
    q = {r["question"]: r for r in IO.load_questions(spark, f"{d}/mini_dev.json").collect()}
    assert (q["q0"]["question_id"], q["q0"]["gold_sql"]) == (7, "SELECT 0")
    assert (q["q1"]["question_id"], q["q1"]["difficulty"], q["q1"]["gold_sql"]) == (1, "unknown", "SELECT 1")
    assert (q["q2"]["gold_sql"], q["q2"]["evidence"]) == ("SELECT 2", "hint")
    assert [r["db_id"] for r in IO.db_ids(IO.load_questions(spark, f"{d}/mini_dev.json")).collect()] == ["a", "b"]
    with open(f"{d}/custom_set.json", "w") as f:
        json.dump([{"question": "x", "sql": "SELECT 1"}], f)
    c = IO.load_custom_questions(spark, f"{d}/custom_set.json").collect()[0]
    assert (c["dataset"], c["db_id"], c["question_id"]) == ("custom_set", "default", 0)
    with open(f"{d}/bad.json", "w") as f:
        json.dump([{"question": "x"}], f)
    with pytest.raises(ValueError):
        IO.load_custom_questions(spark, f"{d}/bad.json")


def test_question_file_is_read_by_many_tasks(spark):
    import random

    rnd = random.Random(3)
    bits = ["}", "{", '"', "\\", "]", "[", ",", "a b", "é", "\n", "{}", '\\"}']
    items = [
        {"question": "".join(rnd.choices(bits, k=rnd.randrange(12))), "SQL": "SELECT '}' || \"x\"", "db_id": f"d{i % 3}",
         "more": {"a": [{"b": "}{"}, {}]}, "evidence": "x" * rnd.randrange(40)}
        for i in range(400)
    ]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for indent in (None, 2):
        d = tempfile.mkdtemp(prefix="askwell-json-", dir="/tmp")
        with open(f"{d}/set.json", "w") as f:
            json.dump(items, f, indent=indent, ensure_ascii=False)
        with open(f"{d}/empty.json", "w") as f:
            f.write(" [ ]\n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        try:
            assert spark.read.option("lineSep", "}").text(d).select("_metadata.file_block_start").distinct().count() > 10
            got = {r["question_id"]: r for r in IO.load_questions(spark, d).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert [got[i]["question"] for i in range(len(items))] == [x["question"] for x in items]
        assert [got[i]["evidence"] for i in range(len(items))] == [x["evidence"] for x in items] and len(got) == len(items)
    with open(f"{d}/cut.json", "w") as f:
        f.write('[{"question": "x", "sql": "SELECT 1"}, {"question": "y", "sq')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        IO.load_questions(spark, f"{d}/cut.json").collect()


def test_store_append_is_idempotent(spark):
    d = tempfile.mkdtemp(prefix="askwell-store-", dir="/tmp")
    ex = spark.createDataFrame([("e1", "q", "SELECT 1")], "example_id string, question string, sql_query string")
    IO.append_examples(ex, f"{d}/s", 0)
    IO.append_examples(ex, f"{d}/s", 1)
    IO.append_examples(ex, f"{d}/s", 1)  # replay of batch 1
    assert IO.store_count(spark, f"{d}/s") == 2
    assert IO.read_store(spark, f"{d}/s", before_batch=1).count() == 1


def test_ingest_quarantines_bad_rows(spark):
    d = tempfile.mkdtemp(prefix="askwell-ingest-", dir="/tmp")
    with open(f"{d}/t.json", "w") as f:
        f.write('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\nnot json\n')
    stats = IO.ingest_table_set(spark, {"t": f"{d}/t.json", "sqlite_master": f"{d}/t.json"}, f"{d}/out",
                                schemas={"t": "a long, b string"}).collect()
    assert [(r["table_name"], r["loaded"], r["quarantined"]) for r in stats] == [("t", 2, 1)]

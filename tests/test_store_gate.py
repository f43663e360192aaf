from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from askwell.functions.sql_scan import REASON_SHAPE, REASON_TABLE, blanked, tables_read, validate_texts
from askwell.functions.text import REASON_EMPTY, REASON_WRITE
from askwell.operators import feedback as FB
from askwell.operators.profile import table_profiles
from askwell.sources import io as IO

READS = {
    "SELECT 1": [],
    "select * from A, b x, s.c as y, \"D\" where a.k in (select k from e)": ["a", "b", "c", "d", "e"],
    "SELECT 'from x' FROM t -- join u\n JOIN /* from v */ w ON 1 = 1": ["t", "w"],
    "WITH r AS (SELECT 1), q(a, b) AS (SELECT * FROM r JOIN s USING (k)) SELECT * FROM q": ["s"],
    "SELECT extract(year FROM d), trim(both ' ' from n) FROM t WHERE a IS DISTINCT FROM b": ["t"],
    "SELECT * FROM range(10) CROSS JOIN t ORDER BY x, y": ["t"],
    "SELECT fromage, x.from FROM a JOIN b ON TRUE LEFT JOIN c ON TRUE": ["a", "b", "c"],
    "SELECT 'it''s -- from z' FROM `t`": ["t"],
    None: [],
}


def test_tables_read(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(READS)], "i int, sql string")
    got = {r.i: r.t for r in df.select("i", tables_read(blanked("sql")).alias("t")).collect()}
    assert [got[i] for i in range(len(READS))] == list(READS.values())


def test_validate_texts_edges(spark):
    cases = [
        (None, REASON_EMPTY), (" \n", REASON_EMPTY), ("select * from T1;", None), ("select * from T1;", None),
        ("drop table t1", REASON_WRITE), ("words from t1", REASON_SHAPE), ("select (1 from t1", REASON_SHAPE),
        ("select 1; select 2", REASON_SHAPE), ("select 'open from t1", REASON_SHAPE),
        ("select * from zz, yy join t1", REASON_TABLE + "yy"), ("select 1 " + "/* from nowhere */ " * 20_000 + "from t1", None),
        ("select " + "x, " * 100_000 + "y from " + "t1, " * 5_000 + "no", REASON_TABLE + "no"),
    ]
    df = spark.createDataFrame([(i % 2, q, r, i) for i, (q, r) in enumerate(cases)], "id int, sql string, table_name string, i int")
    cat = spark.createDataFrame([("t1",), ("T1",)], "table_name string")
    got = {r.i: r.reason for r in validate_texts(df, "sql", cat).collect()}
    assert [got[i] for i in range(len(cases))] == [r for _, r in cases]
    assert validate_texts(df.limit(0), "sql", cat).count() == 0
    assert validate_texts(df, "sql", cat.limit(0)).filter("reason is null").count() == 0


def test_store_shows_finished_batches_only(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="askwell-store-", dir="/tmp") + "/s"
    one = spark.createDataFrame([("a",), ("b",)], "question string")
    assert IO.store_count(spark, path) == 0 and IO.next_batch(spark, path) == 0
    assert IO.append_examples(one, path, 0) == 2
    before = IO.read_store(spark, path)

    def broken(*_):
        raise OSError("gone between the files and the log")

    with monkeypatch.context() as m:
        m.setattr(IO, "_commit", broken)
        with pytest.raises(OSError):
            IO.append_examples(one, path, 1)
    assert IO.store_count(spark, path) == IO.read_store(spark, path).count() == 2
    assert IO.append_examples(one.limit(1), path, 1) == 1  # the same batch again, whole
    assert IO.append_examples(one.limit(0), path, 2) == 0
    assert IO.store_count(spark, path) == IO.read_store(spark, path).count() == 3
    assert IO.read_store(spark, path, before_batch=1).count() == before.count() == 2
    assert IO.next_batch(spark, path) == 3


def test_manual_add_appends(spark):
    path = tempfile.mkdtemp(prefix="askwell-store-", dir="/tmp") + "/s"
    cat = spark.createDataFrame([("orders",)], "table_name string")
    cands = spark.createDataFrame(
        [("how many orders are there", "SELECT COUNT(*) FROM orders"), ("names of people", "SELECT n FROM people"),
         ("how many orders are there", "SELECT 1 FROM orders")], "question string, sql_query string").coalesce(1)
    out = {r.seq: (r.added, r.message) for r in FB.manual_add(spark, cands, path, catalogue=cat).collect()}
    assert out == {1: (True, FB.ADDED), 2: (False, FB.FAILED + REASON_TABLE + "people"), 3: (False, FB.DUPLICATE)}
    assert [(r.question, r.sql_query, r.batch_id) for r in IO.read_store(spark, path).collect()] == [
        ("how many orders are there", "SELECT COUNT(*) FROM orders", 0)]
    again = FB.manual_add(spark, cands, path, catalogue=cat).collect()
    assert not any(r.added for r in again) and IO.store_count(spark, path) == 1


def test_profile_sample_does_not_depend_on_the_split(spark):
    df = spark.range(50).select("id", F.concat(F.lit("r"), "id").alias("t"), (F.col("id") / 7).alias("x"))
    df = df.withMetadata("t", {"comment": "the name"})
    many, one = (table_profiles(spark, {"t": d}, sample_rows=4).first() for d in (df.repartition(7), df.coalesce(1)))
    assert many == one and len(one.sample_rows) == 4 and one.row_count == 50 and one.column_descriptions["t"] == "the name"
    empty = table_profiles(spark, {"t": df.limit(0)}).first()
    assert empty.sample_rows == [] and empty.row_count == 0

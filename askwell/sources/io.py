"""File sources and sinks: question sets (S1, S2), the example store (S6, S7),
reports (S12) and bulk table ingestion (S13)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askwell.session import materialize
from askwell.sources.fixtures import EXAMPLE_SCHEMA, QUESTION_SCHEMA

# items are parsed as string maps: keys stay case-sensitive ("SQL" vs "sql"),
# which struct fields in a case-insensitive session would not
_ITEM = "map<string,string>"


def _json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, item) for every object of the top-level JSON array in each file.

    A large file is read by many tasks.  Spark cuts it at closing braces, so an
    object is a run of whole pieces; it ends with the piece after which no brace
    is open.  Whether a piece starts inside a string, and how many braces are open
    there, follows from quotes and braces before it: these are summed inside each
    split and then over the splits of a file (one row a split).  Only the objects
    that are put together are shuffled, each by its own number.

    Elements have to be objects and texts UTF-8; what isn't valid JSON raises an
    error when the rows are read.  An empty array gives no rows."""
    raw = spark.read.option("lineSep", "}").text(path)
    text = F.regexp_replace("value", r"\\.", "")  # escaped signs open and close nothing
    parts = F.split(text, '"')

    def net(parity: int) -> Column:
        """Braces opened less those closed in a piece that starts outside (0) or
        inside (1) of a string; the piece's own closing brace counts where it ends outside."""
        out = F.array_join(F.filter(parts, lambda _, i: i % 2 == parity), "")
        opened = F.length(out) - F.length(F.translate(out, "{", ""))
        ends_outside = (F.size(parts) - 1 + parity) % 2 == 0
        return opened - F.when(ends_outside, 1).otherwise(0)

    pieces = materialize(
        raw.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"), "value",
            (F.size(parts) - 1).alias("quotes"), net(0).alias("net_out"), net(1).alias("net_in"),
        ),
        "json-pieces",
    )
    inside = Window.partitionBy("file", "split").orderBy("at")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    run = pieces.select(
        "*", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("odd")
    ).select(
        "*",
        # net braces of the piece if the split starts outside (0) or inside (1) of a string
        F.when(F.col("odd") == 0, F.col("net_out")).otherwise(F.col("net_in")).alias("net0"),
        F.when(F.col("odd") == 0, F.col("net_in")).otherwise(F.col("net_out")).alias("net1"),
    )
    splits = run.groupBy("file", "split").agg(
        F.sum("quotes").alias("quotes"), F.sum("net0").alias("net0"), F.sum("net1").alias("net1")
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("*", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).alias("starts_in")).select(
        "file", "split", "starts_in",
        F.coalesce(F.sum(F.when(F.col("starts_in") == 0, F.col("net0")).otherwise(F.col("net1"))).over(earlier), F.lit(0)).alias("open_before"),
    )
    net_here = F.when(F.col("starts_in") == 0, F.col("net0")).otherwise(F.col("net1"))
    known = run.join(starts, ["file", "split"]).select("file", "split", "at", "value", "open_before", net_here.alias("net"), ((F.col("odd") + F.col("starts_in")) % 2).alias("in_string"))
    known = known.withColumn("open", F.col("open_before") + F.sum("net").over(inside))
    # between objects there is no brace open and none is opened: the end of the file
    tail = (F.col("open") - F.col("net") == 0) & (F.col("in_string") == 0) & ~F.col("value").contains("{")
    known = known.filter(~tail).withColumn("ends", (F.col("open") == 0).cast("long"))
    known = known.withColumn("nth", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    ended = known.groupBy("file", "split").agg(F.sum("ends").alias("n"))
    first = ended.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    whole = known.join(first, ["file", "split"]).groupBy("file", (F.col("first") + F.col("nth")).alias("pos")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda p: p["value"]), "}").alias("text"),
        F.sum("net").alias("left_open"),
    )
    body = F.regexp_replace("text", r"^[\s\x{FEFF}]*[\[,]?\s*", "")
    item = F.from_json(
        F.when(F.col("left_open") == 0, F.concat(body, F.lit("}"))).otherwise(body), _ITEM, {"mode": "FAILFAST"}
    )
    return whole.select("file", "pos", item.alias("item"))


def load_questions(spark: SparkSession, path: str, dataset: str = "BIRD-Mini-Dev") -> DataFrame:
    """Benchmark JSON -> questions.  Gold text from ``SQL`` else ``sql``
    else ``query``; missing question_id -> position in the file; missing
    difficulty -> 'unknown'."""
    items = _json_arrays(spark, path)
    i = F.col("item")
    return items.select(
        F.lit(dataset).alias("dataset"),
        F.coalesce(i["question_id"].cast("long"), F.col("pos").cast("long")).alias("question_id"),
        F.coalesce(i["db_id"], F.lit("")).alias("db_id"),
        F.coalesce(i["difficulty"], F.lit("unknown")).alias("difficulty"),
        F.coalesce(i["question"], F.lit("")).alias("question"),
        F.coalesce(i["SQL"], i["sql"], i["query"], F.lit("")).alias("gold_sql"),
        F.coalesce(i["evidence"], F.lit("")).alias("evidence"),
    )


def load_custom_questions(spark: SparkSession, path: str) -> DataFrame:
    """Strict JSON: ``question`` and ``sql`` required (raises otherwise);
    db_id defaults to 'default'; id = position; dataset = file stem."""
    items = _json_arrays(spark, path)
    i = F.col("item")
    bad = items.filter(i["question"].isNull() | i["sql"].isNull()).limit(1).count()
    if bad:
        raise ValueError("custom question file: every item needs 'question' and 'sql'")
    stem = F.regexp_extract(F.col("file"), r"([^/]+?)(\.[^./]*)?$", 1)
    return items.select(
        stem.alias("dataset"),
        F.col("pos").cast("long").alias("question_id"),
        F.coalesce(i["db_id"], F.lit("default")).alias("db_id"),
        F.coalesce(i["difficulty"], F.lit("unknown")).alias("difficulty"),
        i["question"].alias("question"),
        i["sql"].alias("gold_sql"),
        F.lit("").alias("evidence"),
    )


def filter_by_db(questions: DataFrame, db_id: str) -> DataFrame:
    """F1."""
    return questions.filter(F.col("db_id") == db_id)


def db_ids(questions: DataFrame) -> DataFrame:
    """Sorted distinct database ids."""
    return questions.select("db_id").distinct().orderBy("db_id")


def first_questions(questions: DataFrame, n: int) -> DataFrame:
    """the first n questions by id (a benchmark ``--limit``)."""
    return questions.orderBy("question_id").limit(n)


# The example store: ``batches/`` holds one folder of Parquet files for every write
# that was ever begun, ``log/`` one line per batch that was finished.  Readers take the
# folders that the log names, so a write that broke off is never seen.
_LOG = "folder string, n_rows long, batch_id long"


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The finished batches (folder, n_rows, batch_id)."""
    try:
        return spark.read.schema(_LOG).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def _commit(spark: SparkSession, path: str, batch_id: int, folder: str, n_rows: int) -> None:
    line = spark.createDataFrame([(folder, n_rows)], "folder string, n_rows long")
    line.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")


def append_examples(examples: DataFrame, path: str, batch_id: int) -> int:
    """Write one batch of examples, then its line in the log.  A batch that is
    written again (a replay) replaces its line and so itself; one that breaks off
    before the line leaves the store as it was.  Returns the number of rows."""
    spark = examples.sparkSession
    out = examples.withColumn("batch_id", F.lit(batch_id).cast("long"))
    cols = [c.split(" ", 1) for c in EXAMPLE_SCHEMA.split(", ")]
    out = out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in cols])
    folder = f"batches/{batch_id}-{uuid.uuid4().hex}"
    out.write.parquet(f"{path}/{folder}")
    # the count reads Parquet footers; the plan that made the rows isn't run again
    n_rows = spark.read.schema(EXAMPLE_SCHEMA).parquet(f"{path}/{folder}").count()
    _commit(spark, path, batch_id, folder, n_rows)
    return n_rows


def read_store(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """The example store as the log names it now: what is written later doesn't
    change this result.  ``before_batch`` reads only earlier batches (a replayed
    micro-batch must not see its own output).  The driver holds one folder name a batch."""
    log = _log(spark, path)
    if before_batch is not None:
        log = log.filter(F.col("batch_id") < before_batch)
    folders = [f"{path}/{r['folder']}" for r in log.select("folder").collect()]
    if not folders:
        return spark.createDataFrame([], EXAMPLE_SCHEMA)
    return spark.read.schema(EXAMPLE_SCHEMA).parquet(*folders)


def store_count(spark: SparkSession, path: str) -> int:
    """Exact number of stored examples, from the log alone."""
    return _log(spark, path).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]


def next_batch(spark: SparkSession, path: str) -> int:
    """The batch number after the last finished one; 0 for an empty store."""
    return _log(spark, path).agg(F.coalesce(F.max("batch_id") + 1, F.lit(0))).first()[0]


def write_report(path: str, scored: DataFrame, summary: DataFrame, by_difficulty: DataFrame) -> None:
    """The report as JSON lines in three folders (summary, by_difficulty,
    details).  Details stay one line per (strategy, question) — never nested
    under one strategy row, so no report section is gathered in one task."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    by_difficulty.write.mode("overwrite").json(f"{path}/by_difficulty")
    scored.write.mode("overwrite").json(f"{path}/details")


def ingest_table_set(
    spark: SparkSession,
    tables: dict[str, str],
    dst: str,
    *,
    fmt: str = "json",
    schemas: dict[str, str] | None = None,
    skip_prefixes: tuple[str, ...] = ("sqlite_",),
) -> DataFrame:
    """Load every table of an external set into the warehouse.  Rows
    that fail to parse go to ``dst/_quarantine/<table>`` instead of being
    dropped one by one; system tables are skipped.  Returns (table_name,
    loaded, quarantined)."""
    stats = []
    for name, src in tables.items():
        if name.startswith(skip_prefixes):
            continue
        reader = spark.read.format(fmt).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", "_corrupt_record"
        )
        if fmt == "csv":
            reader = reader.option("header", True)
        if schemas and name in schemas:
            reader = reader.schema(schemas[name] + ", _corrupt_record string")
        df = reader.load(src).cache()  # parse once for both outputs (Spark requires it for corrupt-record queries)
        if "_corrupt_record" in df.columns:
            good = df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
            bad = df.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
        else:
            good, bad = df, None
        good.write.mode("overwrite").parquet(f"{dst}/{name}")
        nbad = 0
        if bad is not None:
            bad.write.mode("overwrite").json(f"{dst}/_quarantine/{name}")
            nbad = spark.read.json(f"{dst}/_quarantine/{name}").count() if bad.limit(1).count() else 0
        stats.append((name, spark.read.parquet(f"{dst}/{name}").count(), nbad))
        df.unpersist()
    return spark.createDataFrame(stats, "table_name string, loaded long, quarantined long")


QUESTIONS_SCHEMA = QUESTION_SCHEMA

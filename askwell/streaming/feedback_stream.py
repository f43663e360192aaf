"""ST2-ST4: the feedback loop as Structured Streaming.

    traces stream --+
                    +-- stream-stream inner join on trace_id, score within
    scores stream --+   [trace ts, trace ts + 7 days], watermarks on both
                    -> keyed state: one positive record per trace
                    -> foreachBatch: gates, dedup against the store snapshot
                       and within the batch, write the accepted examples as
                       partition batch_id

The reference polls every 60 s and re-reads everything (no cursor); here the
checkpoint is the cursor.  Which traces have been handed on is keyed state of
the query (``FirstPositive``), seeded once with the trace ids of the store, so a
micro-batch never joins the whole store for it; a replayed micro-batch finds the
state of its own version, reads the store with ``batch_id < current`` and
overwrites its own partition.  Join state is bounded by the 7-day rule and the
watermarks, the keyed state by a timer at the same horizon; a score later than
that is dropped (counted by Spark's late-row metrics).
"""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from askwell.operators import feedback as FB
from askwell.session import ensure_checkpoint_dir
from askwell.sources import io as IO

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: keyed state with timers is kept by this state store (fixed value)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HORIZON_MS = 7 * 24 * 3600 * 1000
HORIZON = "7 days"


def positive_stream(
    traces: DataFrame,
    scores: DataFrame,
    *,
    watermark: str = "1 day",
    horizon: str = HORIZON,
    name: str = FB.SCORE_NAME,
    threshold: float = FB.POSITIVE_THRESHOLD,
) -> DataFrame:
    """ST3: qualifying (trace, score) pairs as a stream.  Both event times are
    TIMESTAMP (watermarks need it); after the join only the trace's event
    time stays an event-time column, the score time is carried as a number
    (a later stateful step or sink rejects two event-time columns)."""
    t = traces.select(
        F.col("trace_id").alias("t_id"),
        F.col("ts").cast("timestamp").alias("t_ts"),
        F.when(F.col("metadata.question").isNotNull(), F.col("metadata.question"))
        .otherwise(F.coalesce(F.col("input"), F.lit(""))).alias("question"),
        F.coalesce(F.col("metadata.generated_sql"), F.lit("")).alias("generated_sql"),
    ).withWatermark("t_ts", watermark)
    s = scores.filter(FB.positive_scores(scores, name=name, threshold=threshold)).select(
        F.col("trace_id").alias("s_id"),
        F.col("ts").cast("timestamp").alias("s_ts"),
        F.col("value").alias("score_value"),
        F.coalesce(F.col("comment"), F.lit("")).alias("score_comment"),
    ).withWatermark("s_ts", watermark)
    j = t.join(
        s,
        F.expr(f"t_id = s_id AND s_ts >= t_ts AND s_ts <= t_ts + INTERVAL {horizon}"),
        "inner",
    )
    return j.select(
        F.col("t_id").alias("trace_id"),
        F.col("t_ts").alias("ts"),
        "question",
        "generated_sql",
        "score_value",
        "score_comment",
        F.unix_micros("s_ts").alias("score_us"),
    )


class FirstPositive(StatefulProcessor):
    """ST4: one record per trace, its first score by (time, value, comment).

    The state of a trace is its best score so far and whether it was handed on.
    Without ``settle`` the best score of the micro-batch that first has one is
    handed on at once.  With ``settle`` it waits until the watermark has passed
    the score's time, so that a score that comes late but is earlier still wins:
    the records are then those of the batch join (J6), whatever the order of
    arrival.  Either way later scores of the trace find it handed on; the state
    goes when the watermark has passed the trace's horizon."""

    def __init__(self, settle: bool):
        self.settle = settle

    def init(self, handle) -> None:
        self.handle = handle
        self.best = handle.getValueState(
            "best", "ts_us long, question string, generated_sql string, score_us long, score_value double, score_comment string, done boolean"
        )

    def _record(self, key, best) -> pd.DataFrame:
        names = ["ts_us", "question", "generated_sql", "score_us", "score_value", "score_comment"]
        return pd.DataFrame([[key[0], *best[:6]]], columns=["trace_id", *names])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.best.get()) if self.best.exists() else None
        if held is not None and held[6]:
            for _ in rows:
                pass
            return
        best = held
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                one = (int(r.ts_us), r.question, r.generated_sql, int(r.score_us), float(r.score_value), r.score_comment, False)
                if best is None or one[3:6] < best[3:6]:
                    best = one
        if best is None:
            return
        if self.settle:
            if held is not None:
                self.handle.deleteTimer(held[3] // 1000)
            self.best.update(best)
            self.handle.registerTimer(best[3] // 1000)
        else:
            self.best.update((*best[:6], True))
            self.handle.registerTimer(best[0] // 1000 + HORIZON_MS)
            yield self._record(key, best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = tuple(self.best.get()) if self.best.exists() else None
        if best is not None and not best[6]:
            self.best.update((*best[:6], True))
            self.handle.registerTimer(max(best[0] // 1000 + HORIZON_MS, best[3] // 1000 + 1))
            yield self._record(key, best)
        else:
            self.best.clear()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A trace of the store counts as handed on until its horizon."""
        known = initialState["until_ms"].iloc[0]
        self.best.update((0, "", "", 0, 0.0, "", True))
        self.handle.registerTimer(int(known))

    def close(self) -> None:
        pass


def first_positive_stream(positives: DataFrame, store: DataFrame | None = None, *, settle: bool = False) -> DataFrame:
    """ST4 on ``positive_stream``: one record per trace, none for traces that
    ``store`` (trace_id, created_at) held when the query was first started."""
    spark = positives.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    seed = None
    if store is not None:
        until = F.coalesce(F.unix_millis("created_at"), F.lit(int(time.time() * 1000))) + F.lit(HORIZON_MS)
        seed = store.filter(F.col("trace_id").isNotNull()).groupBy("trace_id").agg(F.max(until).alias("until_ms")).groupBy("trace_id")
    out = positives.withColumn("ts_us", F.unix_micros("ts")).groupBy("trace_id").transformWithStateInPandas(
        FirstPositive(settle),
        "trace_id string, ts_us long, question string, generated_sql string, score_us long, score_value double, score_comment string",
        "Append",
        "EventTime",
        seed,
    )
    return out.select(
        "trace_id", F.timestamp_micros("ts_us").alias("ts"), "question", "generated_sql", "score_value", "score_comment"
    )


def make_batch_handler(
    spark: SparkSession,
    store_path: str,
    stats_path: str,
    *,
    threshold: float = 0.95,
    analyse: bool = False,
):
    """foreachBatch body: gates + dedup + idempotent append (ST2).

    With ``analyse``, E9's analysis runs on the distinct SQL texts of the
    micro-batch (a bounded set: the sources' limits per trigger)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ensure_checkpoint_dir(spark)
        store = IO.read_store(spark, store_path, before_batch=batch_id)
        analysable = FB.analysable_texts(spark, batch.select("generated_sql")) if analyse else None
        out = FB.process_positives(batch, store.select("question"), threshold=threshold, analysable=analysable).checkpoint()
        accepted = out.filter(F.col("status") == FB.APPROVED).select(
            F.concat(F.lit("fb-"), F.col("trace_id")).alias("example_id"),
            "question",
            F.col("generated_sql").alias("sql_query"),
            F.col("score_comment").alias("explanation"),
            F.array().cast("array<string>").alias("tables_used"),
            F.current_timestamp().alias("created_at"),
            "trace_id",
        )
        IO.append_examples(accepted, store_path, batch_id)
        FB.gate_stats(out).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(stats_path)

    return handle


def start_feedback_stream(
    spark: SparkSession,
    traces: DataFrame,
    scores: DataFrame,
    store_path: str,
    *,
    stats_path: str,
    checkpoint: str,
    trigger_seconds: int | None = FB.POLL_SECONDS,
    available_now: bool = False,
    threshold: float = 0.95,
    settle: bool = False,
    analyse: bool = False,
    handler: Callable[[DataFrame, int], None] | None = None,
):
    """ST2: start the query.  ``available_now`` processes what is there and
    stops (ST1 as a stream); otherwise a micro-batch every ``trigger_seconds``
    (the reference's poll interval).  An error in a micro-batch stops the query;
    ``supervise`` starts it again from its checkpoint."""
    pos = positive_stream(traces, scores)
    first = first_positive_stream(pos, IO.read_store(spark, store_path), settle=settle)
    handler = handler or make_batch_handler(spark, store_path, stats_path, threshold=threshold, analyse=analyse)
    w = first.writeStream.outputMode("append").foreachBatch(handler).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


class BatchCounter(StreamingQueryListener):
    """Counts the finished micro-batches of the queries it is told of."""

    def __init__(self):
        self.queries: set[str] = set()
        self.batches: set[int] = set()
        self.enough = threading.Event()
        self.most: int | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) in self.queries:
            self.batches.add(event.progress.batchId)
            if self.most is not None and len(self.batches) >= self.most:
                self.enough.set()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@dataclass
class LoopReport:
    """What a supervised loop did."""

    batches: int = 0
    restarts: int = 0
    errors: list[str] = field(default_factory=list)


def supervise(
    spark: SparkSession,
    start: Callable[[], object],
    *,
    max_batches: int | None = None,
    max_restarts: int = 10,
    pause_seconds: float = 1.0,
) -> LoopReport:
    """ST2 as a loop: run the query that ``start`` starts until it has finished
    ``max_batches`` micro-batches (None: until it ends by itself).

    An error ends a micro-batch, not the loop: it is noted and, after a pause,
    the query starts again from its checkpoint, with the same micro-batch.  After
    ``max_restarts`` errors the last one is raised."""
    report, counter = LoopReport(), BatchCounter()
    counter.most = max_batches
    spark.streams.addListener(counter)
    try:
        while True:
            query = start()
            counter.queries.add(str(query.id))
            try:
                while not query.awaitTermination(1):
                    if counter.enough.is_set():
                        query.stop()
                break
            except Exception as e:
                report.errors.append(str(e).strip().splitlines()[0][:500])
                if report.restarts >= max_restarts:
                    raise
                report.restarts += 1
                threading.Event().wait(pause_seconds)
        counter.enough.wait(0.5 if max_batches is None else 0)  # progress events come a little later
    finally:
        spark.streams.removeListener(counter)
    report.batches = len(counter.batches)
    return report

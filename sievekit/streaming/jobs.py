"""Structured Streaming jobs.

* ``screen_stream`` (requests -> verdict log, plus the blocked-request feed):
  screening is row by row, so each micro-batch runs the batch code in
  ``foreachBatch``; both sinks are written from one persisted batch. Writes go
  to a directory named after the batch id and overwrite it, so a retried batch
  replaces its own output instead of appending twice. The batch's counters are
  observed while it is written and stored beside it. ``max_files`` bounds a
  batch, so a backlog is worked off in pieces.
* ``daily_counter_stream``: event-time daily counters. Update mode sends the
  days that changed; each replaces its own partition. With a watermark (a live
  stream) days behind it leave the state and later rows of them are dropped;
  without one (a backlog, whose files come in any order of event time) no row
  is late, and the state is one row per day.

Checkpoints and sinks must live on shared storage; by default they go under
the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.logs import BLOCK_REASON
from ..operators.score import RuleScorer, counter_row, observed, screen
from ..session import ensure_checkpoint_dir, read_parts
from ..sources import tables as T

MAX_FILES = 64  # files of a micro-batch
MARK = "epoch LONG, newest TIMESTAMP"
EVENT_SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
                "value DOUBLE, props STRING")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events*.parquet",
                 max_files: int | None = None) -> DataFrame:
    """New event files arriving in ``folder`` (only names matching ``file_glob``)."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def request_stream(spark: SparkSession, folder: str, file_glob: str = "events*.parquet",
                   max_files: int | None = MAX_FILES) -> DataFrame:
    """Requests derived from a stream of events (stream-static broadcast join)."""
    return T.requests_from_events(spark, event_stream(spark, folder, file_glob, max_files))


def _with_event_time(df: DataFrame, ts: str = "created_at") -> DataFrame:
    # Watermarks need TIMESTAMP; the source column is TIMESTAMP_NTZ (UTC wall time).
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def screen_stream(spark: SparkSession, requests: DataFrame, log_path: str, blocked_path: str,
                  checkpoint: str, scorer=None, available_now: bool = True, counters_path: str | None = None,
                  carry=("request_id", "query", "user_id", "endpoint", "created_at")) -> StreamingQuery:
    scorer = scorer or RuleScorer()

    def write_batch(batch: DataFrame, epoch: int) -> None:
        v = screen(batch, key="request_id", col="query", scorer=scorer, carry=list(carry)).persist()
        try:
            counted, counters = observed(v)
            (counted.withColumn("log_date", F.to_date("created_at"))
             .write.mode("overwrite").partitionBy("log_date")
             .parquet(f"{log_path}/epoch={epoch}"))
            (v.where(F.col("is_sql_injection"))
             .select(F.col("request_id").alias("id"), "query", "endpoint",
                     F.col("created_at").alias("blocked_at"), F.lit(BLOCK_REASON).alias("reason"))
             .write.mode("overwrite").parquet(f"{blocked_path}/epoch={epoch}"))
            if counters_path:
                (counter_row(spark, counters).coalesce(1).write.mode("overwrite")
                 .parquet(f"{counters_path}/epoch={epoch}"))
        finally:
            v.unpersist()

    w = requests.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def daily_counter_stream(logs: DataFrame, sink: str, checkpoint: str, delay: str | None = "1 day",
                         available_now: bool = True) -> StreamingQuery:
    """Per-day totals and injections, event time, watermark ``delay`` (None: no row is late).

    The sink is partitioned by day; a batch overwrites the days it updates.
    """
    timed = _with_event_time(logs)
    if delay is not None:
        timed = timed.withWatermark("created_at", delay)
    agg = (timed.groupBy(F.window("created_at", "1 day").alias("w"))
           .agg(F.count(F.lit(1)).alias("total_queries"),
                F.count_if(F.col("is_sql_injection")).alias("sql_injections_detected")))

    def write_batch(batch: DataFrame, epoch: int) -> None:
        (batch.select(F.to_date(F.col("w.start")).alias("date"), "total_queries",
                      "sql_injections_detected")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(sink))

    w = agg.writeStream.outputMode("update").foreachBatch(write_batch) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def late_table_stream(logs: DataFrame, base: str, checkpoint: str, delay_days: int = 1,
                      available_now: bool = True) -> StreamingQuery:
    """Daily counters whose late rows go to a table instead of vanishing.

    A row is late if it is over ``delay_days`` behind the newest row of the
    batches before its own. Every batch writes its counts by day, its late rows
    and its newest time to folders named after it, over whatever an earlier
    attempt left; ``daily_totals`` adds the counts up.
    """

    def write_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = (read_parts(spark, f"{base}/marks", MARK).where(F.col("epoch") < epoch)
                  .agg(F.max("newest")).first()[0])  # a row per batch
        bound = F.lit(newest) - F.make_dt_interval(F.lit(delay_days))
        late = F.lit(False) if newest is None else F.coalesce(F.col("created_at") < bound, F.lit(False))
        rows = batch.withColumn("late", late).persist()
        try:
            rows.where("late").drop("late").write.mode("overwrite").parquet(f"{base}/late/epoch={epoch}")
            (rows.where("NOT late").groupBy(F.to_date("created_at").alias("date"))
             .agg(F.count(F.lit(1)).alias("total_queries"),
                  F.count_if(F.col("is_sql_injection")).alias("sql_injections_detected"))
             .write.mode("overwrite").parquet(f"{base}/counts/epoch={epoch}"))
            (rows.agg(F.lit(epoch).cast("long").alias("epoch"), F.max("created_at").alias("newest"))
             .coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/{epoch}"))
        finally:
            rows.unpersist()

    w = _with_event_time(logs).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def daily_totals(spark: SparkSession, base: str) -> DataFrame:
    """Counts by day over all batches, and the late rows of each day beside them."""
    counted = spark.read.parquet(f"{base}/counts").groupBy("date").agg(
        F.sum("total_queries").alias("total_queries"), F.sum("sql_injections_detected").alias("sql_injections_detected"))
    late = spark.read.parquet(f"{base}/late").groupBy(F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("late_rows"))
    both = counted.join(late, "date", "full_outer")
    return both.select("date", *[F.coalesce(c, F.lit(0)).alias(c)
                                 for c in ("total_queries", "sql_injections_detected", "late_rows")])


def run_late_table_stream(spark: SparkSession, folder: str, max_files: int | None = MAX_FILES, delay_days: int = 1) -> str:
    """``late_table_stream`` to completion over the files present; returns its folder."""
    base = scratch(spark, "late")
    logs = T.logs_from_requests(request_stream(spark, folder, max_files=max_files))
    late_table_stream(logs, base, f"{base}/_checkpoint", delay_days).awaitTermination()
    return base


def run_screen_stream(spark: SparkSession, folder: str, scorer=None) -> tuple[str, str]:
    """Run X1+X2 to completion over the files present; returns (log, blocked) paths.
    The counters of each batch are beside them, in ``counters``."""
    base = scratch(spark, "screen")
    log_path, blocked_path = f"{base}/query_logs", f"{base}/blocked_requests"
    q = screen_stream(spark, request_stream(spark, folder), log_path, blocked_path,
                      f"{base}/_checkpoint", scorer, counters_path=f"{base}/counters")
    q.awaitTermination()
    return log_path, blocked_path


def run_daily_counter_stream(spark: SparkSession, folder: str, max_files: int | None = MAX_FILES) -> str:
    """Run X3 over the verdict-log stream derived from the events present; returns the sink.

    Files come in order of modification time and each may hold any days, so no
    row may count as late: the backlog runs without a watermark.
    """
    base = scratch(spark, "daily")
    logs = T.logs_from_requests(request_stream(spark, folder, max_files=max_files))
    q = daily_counter_stream(logs, f"{base}/daily", f"{base}/_checkpoint", delay=None)
    q.awaitTermination()
    return f"{base}/daily"

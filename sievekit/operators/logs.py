"""Log analytics over the verdict, feedback and blocked-request tables.

Tables are append-only parquet partitioned by day (``log_date``), so a time
range filter prunes whole directories before any file is opened. Every
"last N days" window is anchored on an explicit timestamp (default: the
newest row of the log) and compares in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .score import THRESHOLD  # noqa: F401

DEFAULT_DAYS = 7
DEFAULT_PAGE = 100
FEEDBACK_LOOKBACK = 1000
BLOCK_REASON = "SQL injection detected"
FEEDBACK_TYPES = ("false_positive", "false_negative", "correct")


# --- sinks ---------------------------------------------------------------------

def with_log_date(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return df.withColumn("log_date", F.to_date(F.col(ts)))


def append_table(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append rows to a day-partitioned parquet table (one write per job)."""
    with_log_date(df, ts).write.mode("append").partitionBy("log_date").parquet(path)


def verdict_log(verdicts: DataFrame) -> DataFrame:
    """Verdicts (with request_id, query, user_id, endpoint, created_at) as rows
    of the log table. Address and agent follow from the user, as the requests
    carry none."""
    rid, user = F.col("request_id"), F.col("user_id")
    return verdicts.select(
        rid.alias("id"), "query", "is_sql_injection", "confidence", "probability_safe", "probability_injection",
        F.concat(F.lit("10.0."), (user % 256).cast("string"), F.lit("."), (rid % 256).cast("string")).alias("ip_address"),
        F.concat(F.lit("agent-"), (user % 7).cast("string")).alias("user_agent"), "endpoint", "created_at")


def blocked_requests(verdicts: DataFrame, reason: Column | None = None,
                     ts: str = "created_at") -> DataFrame:
    """Requests whose verdict is an injection, in blocked_requests shape."""
    r = F.coalesce(reason, F.lit(BLOCK_REASON)) if reason is not None else F.lit(BLOCK_REASON)
    return verdicts.where(F.col("is_sql_injection")).select(
        "id", "query", "ip_address", "user_agent", "endpoint",
        F.col(ts).alias("blocked_at"), r.alias("reason"))


# --- windows and statistics ----------------------------------------------------------

def newest(df: DataFrame, ts: str = "created_at") -> Column:
    """Scalar subquery: the newest timestamp of ``df``.

    On a day-partitioned table the newest day comes from partition values
    alone, and only that day's rows are read for the time.
    """
    if "log_date" in df.columns:
        df = df.where(F.col("log_date") == df.select(F.max("log_date")).scalar())
    return df.select(F.max(ts)).scalar()


def last_days(df: DataFrame, days: int, anchor: Column, ts: str = "created_at") -> DataFrame:
    """Rows with ``ts >= anchor - days``. On a day-partitioned table also pass
    the date bound so directories are pruned."""
    since = anchor - F.make_dt_interval(F.lit(days))
    out = df.where(F.col(ts) >= since)
    if "log_date" in df.columns:
        out = out.where(F.col("log_date") >= F.to_date(since))
    return out


def statistics(logs: DataFrame, feedback: DataFrame, days: int = DEFAULT_DAYS,
               anchor: Column | None = None) -> DataFrame:
    """One row: total queries, injections, false positives / negatives, days."""
    anchor = newest(logs) if anchor is None else anchor
    lg = last_days(logs, days, anchor).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("is_sql_injection")).alias("sql_injections_detected"))
    fb = last_days(feedback, days, anchor)
    fp = fb.select(F.count_if(F.col("feedback_type") == "false_positive")).scalar()
    fn = fb.select(F.count_if(F.col("feedback_type") == "false_negative")).scalar()
    return lg.select("total_queries", "sql_injections_detected",
                     fp.alias("false_positives"), fn.alias("false_negatives"),
                     F.lit(days).alias("days"))


def daily_statistics(logs: DataFrame, feedback: DataFrame, ts: str = "created_at") -> DataFrame:
    """Per-day counters (the daily_statistics table).

    Both sides are reduced to one row per day before they meet, so the join
    is between two tiny aggregates whatever the log size.
    """
    lg = logs.groupBy(F.to_date(F.col(ts)).alias("date")).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("is_sql_injection")).alias("sql_injections_detected"))
    fb = feedback.groupBy(F.to_date(F.col(ts)).alias("date")).agg(
        F.count_if(F.col("feedback_type") == "false_positive").alias("false_positives"),
        F.count_if(F.col("feedback_type") == "false_negative").alias("false_negatives"))
    j = lg.join(fb, "date", "full_outer")
    return j.select("date", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                              for c in ("total_queries", "sql_injections_detected",
                                        "false_positives", "false_negatives")])


def write_daily_statistics(daily: DataFrame, path: str) -> None:
    """Overwrite only the dates present in ``daily`` (dynamic partition overwrite)."""
    (daily.withColumn("updated_at", F.current_timestamp())
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(path))


def recent(logs: DataFrame, limit: int = DEFAULT_PAGE, is_injection: bool | None = None,
           ts: str = "created_at") -> DataFrame:
    """Newest ``limit`` logs (ties broken by id), optionally one verdict only.

    Planned as a top-k (TakeOrderedAndProject): each task keeps its best
    ``limit`` rows, no full sort.
    """
    df = logs if is_injection is None else logs.where(F.col("is_sql_injection") == F.lit(is_injection))
    return df.orderBy(F.col(ts).desc(), F.col("id").desc()).limit(limit)


# --- feedback --------------------------------------------------------------------

def expected_feedback_type(predicted: Column, actual: Column) -> Column:
    return (F.when(predicted & ~actual, F.lit("false_positive"))
             .when(~predicted & actual, F.lit("false_negative"))
             .otherwise(F.lit("correct")))


def feedback_join(feedback: DataFrame, logs: DataFrame, lookback: int | None = None,
                  ts: str = "created_at") -> DataFrame:
    """Feedback rows with the verdict they refer to.

    By default the whole log is searched (an equi-join; Spark picks the
    strategy from sizes, AQE can switch to broadcast at run time). With
    ``lookback`` only the newest ``lookback`` logs are eligible; that side is
    bounded by construction and therefore broadcast.
    """
    lg = logs.select(F.col("id").alias("log_id"), F.col("is_sql_injection").alias("log_verdict"),
                     F.col(ts).alias("log_created_at"))
    if lookback is not None:
        lg = F.broadcast(recent(lg.withColumnRenamed("log_created_at", ts)
                                .withColumnRenamed("log_id", "id"), lookback, ts=ts)
                         .withColumnRenamed("id", "log_id").withColumnRenamed(ts, "log_created_at"))
    j = feedback.join(lg, F.col("query_log_id") == F.col("log_id"), "left")
    exp = expected_feedback_type(F.col("log_verdict"), F.col("actual_label"))
    return j.select(
        "id", "query_log_id", F.col("log_id").isNotNull().alias("log_found"),
        "actual_label", F.col("log_verdict").alias("predicted_label"), "feedback_type",
        F.when(F.col("log_id").isNotNull(), exp).alias("expected_type"),
        F.when(F.col("log_id").isNotNull(), exp == F.col("feedback_type")).alias("type_consistent"),
        F.col(ts).alias("created_at"),
    )


def feedback_orphans(feedback: DataFrame, logs: DataFrame) -> DataFrame:
    """Feedback that points at no log (rejected rows)."""
    return feedback.join(logs.select(F.col("id").alias("log_id")),
                         F.col("query_log_id") == F.col("log_id"), "left_anti")


def feedback_corpus(feedback: DataFrame, logs: DataFrame, ts: str = "created_at") -> DataFrame:
    """(query, label) from analyst feedback: the latest feedback per log wins.

    Feedback is reduced per log first (partial aggregation, no list
    collected), then joined to the log text.
    """
    latest = feedback.groupBy("query_log_id").agg(
        F.max_by(F.col("actual_label"), F.struct(F.col(ts), F.col("id"))).alias("actual_label"))
    j = latest.join(logs.select(F.col("id").alias("query_log_id"), "query"), "query_log_id")
    return j.select("query_log_id", "query", F.col("actual_label").cast("int").alias("label"))

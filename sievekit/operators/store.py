"""Log tables that a retried job cannot double, and what reads them by batch.

A table is a folder with ``data`` (one folder per batch, partitioned by day)
and ``commits`` (one small file per batch, written after its data). A batch id
names what is appended: its data replaces whatever an earlier attempt left, and
a committed id is not written again. Readers take committed batches only, so a
batch that broke off is invisible. Day filters prune as on a plain table.

``roll_up`` brings a table of daily counters up to date: the commits since its
last run tell which days were touched, and only those days are read and
overwritten. ``by_id`` keeps a copy of the log bucketed by id, so that
joins by id shuffle the other side alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_parts
from .logs import daily_statistics, with_log_date

COMMIT = "batch string, days array<date>, n_rows long"
DAILY_RUN = "table string, batch string"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, days, n_rows) of every committed batch."""
    return read_parts(spark, f"{path}/commits", COMMIT)


def append_batch(df: DataFrame, path: str, batch: str, ts: str = "created_at") -> bool:
    """Append ``df`` as ``batch``; False if that batch is committed already."""
    spark = df.sparkSession
    if not stage_batch(df, path, batch, ts):
        return False
    rows = spark.read.schema(with_log_date(df, ts).schema).parquet(f"{path}/data/batch={batch}")
    done = rows.agg(F.lit(batch).alias("batch"), F.array_sort(F.collect_set("log_date")).alias("days"),  # days, not rows
                    F.count(F.lit(1)).alias("n_rows"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{batch}")
    return True


def stage_batch(df: DataFrame, path: str, batch: str, ts: str = "created_at") -> bool:
    """The first half of ``append_batch``: the data without its commit."""
    if not commits(df.sparkSession, path).where(F.col("batch") == batch).isEmpty():
        return False
    (with_log_date(df, ts).write.mode("overwrite").partitionBy("log_date").parquet(f"{path}/data/batch={batch}"))
    return True


def read_log(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Rows of the committed batches, with ``log_date`` and ``batch``."""
    reader = spark.read.option("basePath", f"{path}/data")
    rows = (reader.schema(schema) if schema is not None else reader).parquet(f"{path}/data")
    done = commits(spark, path).select(F.col("batch").alias("_done"))
    return rows.join(done, F.col("batch").cast("string") == F.col("_done"), "left_semi")


def touched_days(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """(batch, day) of the batches that ``seen`` does not hold."""
    return commits(spark, path).join(seen, "batch", "left_anti").select("batch", F.explode("days").alias("day"))


def roll_up(spark: SparkSession, logs: str, feedback: str, daily: str) -> list:
    """Recount the days that batches since the last run touched, in either
    table; those days, in order. Run again after a failure it does them again."""
    runs = read_parts(spark, f"{daily}/runs", DAILY_RUN)
    fresh = None
    for name, path in (("logs", logs), ("feedback", feedback)):
        seen = runs.where(F.col("table") == name).select("batch").distinct()
        own = touched_days(spark, path, seen).withColumn("table", F.lit(name))
        fresh = own if fresh is None else fresh.unionByName(own)
    fresh = fresh.collect()  # a row per day of a new batch
    days = sorted({r.day for r in fresh})
    if not days:
        return []
    own = [read_log(spark, path).where(F.col("log_date").isin(days)) for path in (logs, feedback)]
    (daily_statistics(*own).where(F.col("date").isin(days)).withColumn("updated_at", F.current_timestamp())
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{daily}/data"))
    batches = sorted({(r.table, r.batch) for r in fresh})
    spark.createDataFrame(batches, DAILY_RUN).coalesce(1).write.mode("append").parquet(f"{daily}/runs")
    return days


def by_id(logs: DataFrame, table: str, path: str, buckets: int = 64, key: str = "id") -> DataFrame:
    """A copy of the log as table ``table`` under ``path``, bucketed and sorted by ``key``."""
    (logs.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path)
     .saveAsTable(table))
    return logs.sparkSession.table(table)

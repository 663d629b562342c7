"""Table readers and the relations derived from the provided tables.

``requests`` turns every event into a screened request (a raw query, a URL
whose parameter carries a payload, or a plain URL), ``query_logs`` and
``feedback_logs`` give the log tables a deterministic content, and
``predictions`` / ``seed_predictions`` stand in for model output so the
evaluation aggregates have an exact answer. All of them grow with ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .templates import TEMPLATE_SCHEMA, template_rows

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

URL_BASE = "https://app.example.com/"
N_MODELS = 5
N_SEEDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def templates(spark: SparkSession) -> DataFrame:
    """The 47 labelled templates (fixed size, safe to broadcast)."""
    return spark.createDataFrame(template_rows(), TEMPLATE_SCHEMA)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event: raw payload, payload in a URL parameter, or plain URL."""
    return requests_from_events(spark, table(spark, sf_dir, "events"))


def requests_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Template choice is ``event_id % 47`` (47 and 3 are coprime, so every
    template appears in all three shapes). The template side has a fixed
    size of 47 rows, so it is broadcast; the event side is never shuffled.
    Works on a batch or a streaming ``events`` frame.
    """
    ev = events.select("event_id", "ts", "user_id", "event_type")
    t = templates(spark)
    n = len(template_rows())
    joined = ev.join(F.broadcast(t), (F.col("event_id") % n) == F.col("tid"))
    shape = F.col("event_id") % 3
    base = F.concat(F.lit(URL_BASE), F.col("event_type"))
    uid = F.concat(F.lit("?uid="), F.col("user_id").cast("string"))
    query = (F.when(shape == 0, F.col("payload"))
              .when(shape == 1, F.concat(base, uid, F.lit("&q="), F.col("payload_enc")))
              .when(F.col("event_id") % 2 == 0,
                    F.concat(base, uid, F.lit("&page="), (F.col("event_id") % 9).cast("string")))
              .otherwise(base))
    return joined.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("created_at"),
        "user_id",
        F.concat(F.lit("/"), F.col("event_type")).alias("endpoint"),
        "tid",
        F.when(shape == 2, F.lit(0)).otherwise(F.col("label")).alias("label"),
        query.alias("query"),
    )


def synthetic_probability(request_id) -> "F.Column":
    """Deterministic stand-in score in [0, 1) for relational checks."""
    return ((request_id * 7919) % 1000).cast("double") / F.lit(1000.0)


def query_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict log with a synthetic probability in place of a model."""
    return logs_from_requests(requests(spark, sf_dir))


def logs_from_requests(r: DataFrame) -> DataFrame:
    p = synthetic_probability(F.col("request_id"))
    inj = p > 0.5
    return r.select(
        F.col("request_id").alias("id"),
        "query",
        inj.alias("is_sql_injection"),
        F.when(inj, p).otherwise(1 - p).alias("confidence"),
        (1 - p).alias("probability_safe"),
        p.alias("probability_injection"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                 (F.col("request_id") % 256).cast("string")).alias("ip_address"),
        F.concat(F.lit("agent-"), (F.col("user_id") % 7).cast("string")).alias("user_agent"),
        "endpoint",
        "created_at",
    )


def feedback_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst feedback on every 17th log; one in five points at no log."""
    return feedback_from_logs(query_logs(spark, sf_dir))


def feedback_from_logs(logs: DataFrame) -> DataFrame:
    lg = logs.where(F.col("id") % 17 == 0)
    kind = F.col("id") % 3
    return lg.select(
        "id",
        F.when(F.col("id") % 5 == 0, F.col("id") + 1000000000).otherwise(F.col("id")).alias("query_log_id"),
        (F.col("id") % 2 == 0).alias("actual_label"),
        F.col("is_sql_injection").alias("predicted_label"),
        F.when(kind == 0, "false_positive").when(kind == 1, "false_negative")
         .otherwise("correct").alias("feedback_type"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("seen: "), "endpoint")).alias("user_feedback"),
        (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
    )


def _model_ids() -> "F.Column":
    return F.explode(F.array(*[F.lit(i) for i in range(N_MODELS)]))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stand-in models with four distinct error rates (0 and 4 tie)."""
    r = requests(spark, sf_dir).select("request_id", "label")
    r = r.select("request_id", "label", _model_ids().alias("model_id"))
    flip = F.col("request_id") % (14 - F.col("model_id") % 4) == 0
    return r.select("request_id", "model_id", "label",
                    F.when(flip, 1 - F.col("label")).otherwise(F.col("label")).alias("prediction"))


def seed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (seed, model) predictions; models 0-2 ran five seeds, model 3 one,
    model 4 failed to fit on every seed (prediction NULL, error set)."""
    r = requests(spark, sf_dir).select("request_id", "label")
    r = r.select("request_id", "label",
                 F.explode(F.array(*[F.lit(s) for s in range(N_SEEDS)])).alias("seed"))
    r = r.select("*", _model_ids().alias("model_id"))
    r = r.where((F.col("model_id") != 3) | (F.col("seed") == 0))
    flip = (F.col("request_id") + F.col("seed") * 3) % (11 + F.col("model_id")) == 0
    failed = F.col("model_id") == 4
    pred = F.when(failed, F.lit(None).cast("int")).when(flip, 1 - F.col("label")).otherwise(F.col("label"))
    return r.select("seed", "model_id", "request_id", "label", pred.alias("prediction"),
                    F.when(failed, F.lit("fit failed")).alias("error"))

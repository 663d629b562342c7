"""Evaluation aggregates: class balance, binary metrics, model choice, seeds.

Metrics are the binary (positive class = 1) definitions with zero_division
= 0, computed from four conditional counts per model in one aggregate, not
through MLlib's evaluators (their default metrics are class-weighted).
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def binary_metrics(pred: DataFrame, group: str = "model_id", label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """tp/fp/fn/tn, accuracy, precision, recall, f1 per ``group``."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    agg = pred.groupBy(group).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = _safe_ratio(tp, tp + fp)
    recall = _safe_ratio(tp, tp + fn)
    f1 = _safe_ratio(2 * tp, 2 * tp + fp + fn)  # = 2PR/(P+R), 0 when undefined
    return agg.select(group, "tp", "fp", "fn", "tn",
                      _safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                      precision.alias("precision"), recall.alias("recall"), f1.alias("f1_score"))


def best_model(metrics: DataFrame, group: str = "model_id", order: str | None = None) -> DataFrame:
    """Highest F1; on ties the model that comes first (``order`` or ``group``)."""
    order = order or group
    return metrics.agg(
        F.max_by(F.col(group), F.struct(F.col("f1_score"), -F.col(order))).alias(group),
        F.max("f1_score").alias("f1_score"))


def seed_accuracy(pred: DataFrame) -> DataFrame:
    """Accuracy per (seed, model); a model that failed to fit keeps its error."""
    ok = F.col("prediction") == F.col("label")
    return pred.groupBy("seed", "model_id").agg(
        F.when(F.count("prediction") > 0, F.count_if(ok).cast("double") / F.count("prediction"))
         .alias("accuracy"),
        F.max("error").alias("error"))


def seed_summary(results: DataFrame, digits: int = 9) -> DataFrame:
    """Mean and sample stdev of accuracy per model over seeds.

    One successful seed → stdev 0.0; none → both NULL; failed seeds are
    skipped but counted in ``n_failed``.
    """
    acc = F.col("accuracy")
    n = F.count(acc)
    return results.groupBy("model_id").agg(
        F.round(F.avg(acc), digits).alias("mean_accuracy"),
        F.round(F.when(n == 1, F.lit(0.0)).when(n > 1, F.stddev_samp(acc)), digits)
         .alias("stdev_accuracy"),
        n.alias("n_seeds"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"))


def scaler_statistics(features: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    """Per-feature mean, population and sample standard deviation.

    One vector summary over the rows (each task sends one row of moments);
    only that single result row is spread out into one row per feature.
    """
    vector = VectorAssembler(inputCols=names, outputCol="_v", handleInvalid="keep").transform(features)
    one = vector.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s"))
    n = F.col("s.count")
    moments = F.arrays_zip(vector_to_array(F.col("s.mean")).alias("mean"),
                           vector_to_array(F.col("s.variance")).alias("var"))
    rows = one.where(n > 0).select(n.alias("n"), F.posexplode(moments).alias("i", "m"))
    # floor at 0: rounding may leave a tiny negative variance
    var = F.greatest(F.col("m.var"), F.lit(0.0))
    return rows.select(
        F.element_at(F.array(*[F.lit(x) for x in names]), F.col("i") + 1).alias("feature"),
        F.round(F.col("m.mean"), digits).alias("mean"),
        F.round(F.sqrt(var * (F.col("n") - 1) / F.col("n")), digits).alias("std_pop"),
        F.when(F.col("n") > 1, F.round(F.sqrt(var), digits)).alias("std_samp"))

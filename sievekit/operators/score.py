"""Screening: text column in, one verdict per row out.

``screen`` routes every row (invalid / URL / raw text), scores raw texts
whole and URLs parameter by parameter, and returns one verdict row per input
row. The scorer is pluggable: ``RuleScorer`` needs no model (its score is a
function of the attack-pattern count, which also makes it checkable against
SQL), ``ModelScorer`` wraps a fitted MLlib ``PipelineModel``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.features import FEATURES, assemble, featurize
from ..functions.patterns import folded_upper, pattern_count
from . import urls

THRESHOLD = 0.5          # injection when strictly above
WARNING_THRESHOLD = 0.35  # triage: suspicious when at least this
NO_PARAMS_SAFE = 0.99
INVALID_ERROR = "Invalid query input"
NO_PARAMS_NOTE = "No parameters found in URL"
ITEMS = "array<struct<pos:int,name:string,value:string,prob:double>>"

VERDICT_COLUMNS = ["route", "is_sql_injection", "confidence", "probability_safe",
                   "probability_injection", "vulnerable_parameter", "suspicious_value",
                   "params_scored", "note", "error"]


class RuleScorer:
    """Score = c / (c + 1.5) for c matched attack rules (no model needed).

    Two or more matching rules cross the 0.5 threshold, one rule lands in the
    warning band. The score is a column expression, so items are scored where
    they lie, inside the row.
    """

    name = "rules"

    def column(self, text: Column, folded: Column | None = None) -> Column:
        c = pattern_count(text, folded=folded).cast("double")
        return c / (c + F.lit(1.5))

    def attach(self, df: DataFrame) -> DataFrame:
        """Add ``_raw_p`` (of ``_raw``) and ``_scored`` (``_items`` with prob)."""
        # The folded text is computed once per item, not once per rule.
        df = df.withColumn("_folded", folded_upper(F.col("_raw"))).withColumn(
            "_with", F.transform("_items", lambda x: F.struct(
                x["pos"].alias("pos"), x["name"].alias("name"), x["value"].alias("value"),
                folded_upper(x["value"]).alias("folded"))))
        scored = F.transform("_with", lambda x: F.struct(
            x["pos"].alias("pos"), x["name"].alias("name"), x["value"].alias("value"),
            self.column(x["value"], x["folded"]).alias("prob")))
        return df.withColumn("_raw_p", self.column(F.col("_raw"), F.col("_folded"))).withColumn("_scored", scored)


@dataclass
class ModelScorer:
    """Probability of class 1 from a fitted pipeline over the 144 features.

    A model scores rows. A row with one item (a raw text, or a URL with one
    scoreable parameter) is scored as it stands; only rows with more items are
    exploded, and gathered again by a row number of their own, never by a
    caller's key.
    """

    model: object  # pyspark.ml.PipelineModel expecting a 'features' column
    name: str = "model"

    def score(self, df: DataFrame, col: str, out: str = "prob") -> DataFrame:
        keep = list(df.columns)
        feats = assemble(featurize(df, col=col, keep=keep))
        pred = self.model.transform(feats)
        prob = vector_to_array(F.col("probability"))[1]
        return pred.select(*[F.col(c) for c in keep],
                           F.when(F.col(col).isNull(), F.lit(None)).otherwise(prob)
                           .cast("double").alias(out))

    def attach(self, df: DataFrame) -> DataFrame:
        """Add ``_raw_p`` (of ``_raw``) and ``_scored`` (``_items`` with prob)."""
        n = F.coalesce(F.size("_items"), F.lit(0))
        item = F.struct("_item.pos", "_item.name", "_item.value", F.col("_p").alias("prob"))
        single = df.where(n <= 1).withColumn("_item", F.when(n == 1, F.col("_items")[0])).withColumn(
            "_one", F.coalesce(F.col("_raw"), F.col("_item.value")))
        single = self.score(single, "_one", out="_p")
        single = single.select(*df.columns, F.when(F.col("_raw").isNotNull(), F.col("_p")).alias("_raw_p"),
                               F.when(F.col("_item").isNotNull(), F.array(item))
                               .when(F.col("_items").isNotNull(), F.array().cast(ITEMS)).alias("_scored"))
        many = df.where(n > 1).withColumn("_row", F.monotonically_increasing_id())
        # Carried columns ride on the first item of a row only.
        exploded = many.select(
            "_row", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_own"),
            F.posexplode("_items").alias("_i", "_item")).select(
                "_row", F.when(F.col("_i") == 0, F.col("_own")).alias("_own"), "_item",
                F.col("_item.value").alias("_one"))
        gathered = self.score(exploded, "_one", out="_p").groupBy("_row").agg(
            F.first("_own", ignorenulls=True).alias("_own"), F.collect_list(item).alias("_scored"))
        return single.unionByName(gathered.select("_own.*", F.lit(None).cast("double").alias("_raw_p"),
                                                  F.col("_scored").cast(ITEMS).alias("_scored")))


def _verdict_from_prob(p: Column) -> dict[str, Column]:
    inj = p > THRESHOLD
    return {
        "is_sql_injection": inj,
        "confidence": F.when(inj, p).otherwise(1 - p),
        "probability_safe": 1 - p,
        "probability_injection": p,
    }


def screen(df: DataFrame, key: str = "request_id", col: str = "query", scorer=None,
           carry: list[str] | None = None, strict_url: bool = False) -> DataFrame:
    """One verdict per input row: ``carry`` columns + ``VERDICT_COLUMNS``.

    Every row keeps the items it is judged by to itself (a raw text is one, a
    URL has its scoreable parameter values, an invalid row none) and is reduced
    inside the row, so repeated and NULL keys are rows like any other. With
    ``RuleScorer`` the plan has no exchange. ``strict_url`` reads only texts
    with scheme and host as URLs.
    """
    scorer = scorer or RuleScorer()
    carry = list(carry) if carry is not None else [key, col]
    if key not in carry:
        carry.insert(0, key)
    q = F.col(f"_in.`{col}`")
    route = F.col("_route")
    is_url, is_raw = route == urls.ROUTE_URL, route == urls.ROUTE_RAW
    staged = df.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, col])]).alias("_in"))
    staged = staged.withColumn("_route", urls.route(q, strict_url))
    staged = staged.withColumn("_params", F.when(is_url, urls.url_params(q)))
    staged = staged.select(
        "_in", "_route", F.size("_params").alias("n_params"), F.when(is_raw, q).alias("_raw"),
        F.filter("_params", lambda p: ~urls.is_alnum(p["value"])).alias("_items"))
    scored = scorer.attach(staged).withColumn("_worst", urls.worst_item(F.col("_scored")))
    p = F.when(is_raw, F.col("_raw_p")).when(is_url, F.col("_worst.prob"))
    none = is_url & (F.col("n_params") == 0)
    hit = is_url & (F.col("_worst.prob") > 0)
    v = _verdict_from_prob(p)
    cols = {
        "route": route,
        "is_sql_injection": F.when(none | ~(is_url | is_raw), F.lit(False)).otherwise(v["is_sql_injection"]),
        "confidence": F.when(none, F.lit(NO_PARAMS_SAFE)).when(is_url | is_raw, v["confidence"])
                       .otherwise(F.lit(0.0)),
        "probability_safe": F.when(none, F.lit(NO_PARAMS_SAFE)).otherwise(v["probability_safe"]),
        "probability_injection": F.when(none, F.lit(1 - NO_PARAMS_SAFE)).otherwise(v["probability_injection"]),
        "vulnerable_parameter": F.when(hit, F.col("_worst.name")),
        "suspicious_value": F.when(hit, F.col("_worst.value")),
        "params_scored": F.when(is_url, F.size("_scored")).cast("long"),
        "note": F.when(none, F.lit(NO_PARAMS_NOTE)),
        "error": F.when(route == urls.ROUTE_INVALID, F.lit(INVALID_ERROR)),
    }
    return scored.select(*[F.col(f"_in.`{c}`") for c in carry], *[cols[n].alias(n) for n in VERDICT_COLUMNS])


def batch_counters(verdicts: DataFrame) -> DataFrame:
    """total_queries and injections_detected over a verdict frame."""
    return verdicts.agg(F.count(F.lit(1)).alias("total_queries"),
                        F.count_if(F.col("is_sql_injection")).alias("injections_detected"))


def observed(verdicts: DataFrame) -> tuple[DataFrame, Observation]:
    """The same verdicts, and counters that fill while they are written: no
    second scan. They are there once the first action over the frame has ended."""
    counters = Observation()
    return verdicts.observe(
        counters, F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("is_sql_injection")).alias("injections_detected"),
        F.count_if(F.col("error").isNotNull()).alias("invalid"),
        F.coalesce(F.sum("params_scored"), F.lit(0)).alias("params_scored")), counters


def counter_row(spark: SparkSession, counters: Observation) -> DataFrame:
    """The filled counters as one row."""
    got = counters.get
    names = ["total_queries", "injections_detected", "invalid", "params_scored"]
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


__all__ = ["observed", "counter_row", "screen", "RuleScorer", "ModelScorer", "batch_counters", "FEATURES", "VERDICT_COLUMNS"]

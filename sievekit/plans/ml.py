"""Training, evaluation, selection and persistence of the five classifiers.

Flow (one Spark job per step, the featurized corpus persisted once and
reused by every fit):

    corpus(query, label) → 144 features → exact stratified split
      → five MLlib pipelines → predictions on the test side
      → binary metrics per model → best F1 (first on ties) → save

Scaling lives inside the pipelines that need it (logistic regression and
the kernel SVM); tree models see raw features, at fit and at score time.
"""

from __future__ import annotations

import json
import math
import uuid
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target, keyword_only
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.features import FEATURE_NAMES, assemble, featurize
from ..operators.evaluation import best_model, binary_metrics
from ..operators.split import cut_hashes, seeded_hash, stratified_split
from ..session import ensure_checkpoint_dir, read_parts, shared_path, spread, written
from . import trees

#: Both boosters and the forest grow on histograms (``trees``), the RBF SVM
#: is approximated by random Fourier features and a linear SVM.
LEARNERS = ["RandomForest", "XGBoost_gbt", "GradientBoosting", "LogisticRegression", "SVM_rff"]

# --- kernel SVM: random Fourier features + linear SVM + Platt scaling ----------------

def _rff_weights(dim_in: int, dim_out: int, gamma: float, seed: int):
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(dim_in, dim_out))
    b = rng.uniform(0.0, 2.0 * math.pi, size=dim_out)
    return w, b


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol,
                            DefaultParamsReadable, DefaultParamsWritable):
    """z(x) = sqrt(2/D)·cos(xW + b): an explicit map whose inner product
    approximates the RBF kernel exp(-gamma·|x-y|²) (Rahimi & Recht, 2007).

    The projection is a fixed-size matrix (inputs × D) drawn from the seed
    once per task; rows are mapped in Arrow batches by one matrix product per
    batch.
    """

    numFeatures = Param(Params._dummy(), "numFeatures", "output dimension D",
                        typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "RBF kernel width", typeConverter=TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "projection seed", typeConverter=TypeConverters.toInt)
    inputDim = Param(Params._dummy(), "inputDim", "input dimension", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="scaled", outputCol="rff", numFeatures=512, gamma=1.0 / 144,
                 seed=42, inputDim=144):
        super().__init__()
        self._setDefault(numFeatures=512, gamma=1.0 / 144, seed=42, inputDim=144)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        d_in, d_out = self.getOrDefault(self.inputDim), self.getOrDefault(self.numFeatures)
        gamma, seed = self.getOrDefault(self.gamma), self.getOrDefault(self.seed)
        scale = math.sqrt(2.0 / d_out)

        def project(batches):
            w, b = _rff_weights(d_in, d_out, gamma, seed)
            for xs in batches:
                z = xs.flatten().to_numpy().reshape(len(xs), d_in) @ w
                z += b
                np.cos(z, out=z)
                z *= scale
                ends = np.arange(0, z.size + 1, d_out, dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))

        project = F.arrow_udf(project, ArrayType(DoubleType()), ArrowUDFType.SCALAR_ITER)
        arr = vector_to_array(F.col(self.getInputCol()))
        return df.withColumn(self.getOutputCol(), array_to_vector(project(arr)))


class MarginColumn(Transformer, HasInputCol, HasOutputCol,
                   DefaultParamsReadable, DefaultParamsWritable):
    """One-element vector holding the positive-class margin of a raw prediction."""

    @keyword_only
    def __init__(self, inputCol="svm_raw", outputCol="margin"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        m = vector_to_array(F.col(self.getInputCol()))[1]
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(m)))


# --- learners -----------------------------------------------------------------------------

def learner_stages(name: str, n_train: int) -> list:
    """Pipeline stages after the 'features' vector for one learner."""
    if name == "LogisticRegression":
        return [_scaler(), LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=1000,
                                              regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                              standardization=False)]
    raise ValueError(name)


def _scaler() -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


UNLIMITED = 64  # levels of a forest's tree where the setting has no limit
CALIBRATION_SHARE = 5  # every fifth training row calibrates the SVM's margin


def fit_svm(train: DataFrame, n_train: int, seed: int = 42) -> PipelineModel:
    """RBF SVM stand-in with calibrated probabilities.

    gamma follows the 'scale' rule 1 / (d * Var(X)): on standardised columns
    the variance is the share of columns that are not constant. The logistic
    curve over the margin is fitted on rows that the SVM it calibrates has not
    seen; the SVM kept is then fitted on all training rows.
    """
    scaler = _scaler().fit(train)
    varied = int(np.count_nonzero(scaler.std.toArray()))
    features = RandomFourierFeatures(inputCol="scaled", outputCol="rff", seed=seed, inputDim=len(FEATURE_NAMES),
                                     gamma=1.0 / max(varied, 1))
    svm = LinearSVC(featuresCol="rff", labelCol="label", maxIter=200, regParam=1.0 / max(n_train, 1),
                    rawPredictionCol="svm_raw", predictionCol="svm_prediction")
    margin = MarginColumn(inputCol="svm_raw", outputCol="margin")
    curve = LogisticRegression(featuresCol="margin", labelCol="label", maxIter=100, regParam=0.0)
    mapped = features.transform(scaler.transform(train))
    aside = F.pmod(F.xxhash64(vector_to_array("features")), F.lit(CALIBRATION_SHARE)) == 0
    some = svm.fit(mapped.where(~aside))
    fitted = curve.fit(margin.transform(some.transform(mapped.where(aside))))
    return PipelineModel([scaler, features, svm.fit(mapped), margin, fitted])


def prepare(corpus: DataFrame, col: str = "query", label: str = "label",
            keep: list[str] | None = None) -> DataFrame:
    """(…, features VECTOR, label DOUBLE) from a (query, label) corpus."""
    keep = list(keep or [])
    base = corpus.select(*keep, F.col(col).alias("query"), F.col(label).cast("double").alias("label"))
    return assemble(featurize(base, "query", keep=[*keep, "label"]))


def fit(name: str, train: DataFrame, n_train: int, seed: int = 42, defaults: bool = False,
        rounds: int = 200) -> PipelineModel:
    """One learner, fitted.

    ``defaults=True`` uses each library's default depth/size (the multi-seed
    experiment setting) instead of the tuned training configuration.
    ``rounds`` is the number of boosting rounds or trees.
    """
    if name == "SVM_rff":
        return fit_svm(train, n_train, seed)
    if name == "XGBoost_gbt":
        p = trees.Boosting(rounds, *((6, 0.3) if defaults else (10, 0.1)))
        return PipelineModel([trees.fit_boosting(train, p)])
    if name == "GradientBoosting":
        return PipelineModel([trees.fit_boosting(train, trees.GradientBoosting(rounds, 3 if defaults else 10))])
    if name == "RandomForest":
        p = (trees.Forest(rounds, depth=UNLIMITED, min_split=2, min_leaf=1, seed=seed) if defaults else
             trees.Forest(rounds, seed=seed))
        return PipelineModel([trees.fit_forest(train, p)])
    return Pipeline(stages=learner_stages(name, n_train)).fit(train)


def predictions(model: PipelineModel, data: DataFrame, name: str) -> DataFrame:
    out = model.transform(data)
    return out.select(F.lit(name).alias("model"), F.col("label").cast("int").alias("label"),
                      F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array(F.col("probability"))[1].alias("probability_injection"))


def train_evaluate(spark: SparkSession, corpus: DataFrame, key: str, learners=LEARNERS,
                   test_size: float = 0.2, seed: int = 42, defaults: bool = False, rounds: int = 200):
    """Fit every learner on the training side; metrics on the test side.

    Returns (metrics DataFrame, {name: PipelineModel}, featurized data). The
    metrics are computed here, one row per learner; they carry the learner's
    training order so ties go to the earlier one, and the sizes of both sides.
    The data is read from a table in the shared folder, so no cache is left.
    """
    split = stratified_split(corpus.select(key, "query", "label"), key, "label", test_size, seed)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}"
    prepare(spread(split), keep=[key, "is_test"]).select(key, "label", "is_test", "features").write.parquet(path)
    data = spark.read.parquet(path)
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    n_train, n_test = train.count(), test.count()
    models, rows = {}, []
    train.persist()
    try:
        for i, name in enumerate(learners):
            models[name] = fit(name, train, n_train, seed, defaults, rounds)
            # one metrics row per fit: an aggregate, safe to bring back
            m = binary_metrics(predictions(models[name], test, name), group="model").first()
            rows.append((name, *(m[c] for c in METRICS), n_train, n_test, i))
    finally:
        train.unpersist()
    metrics = spark.createDataFrame(rows, "model STRING, tp LONG, fp LONG, fn LONG, tn LONG, accuracy DOUBLE, "
                                          "precision DOUBLE, recall DOUBLE, f1_score DOUBLE, n_train LONG, "
                                          "n_test LONG, ordinal INT")
    return metrics, models, data


METRICS = ["tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1_score"]


def select_best(metrics: DataFrame) -> DataFrame:
    return best_model(metrics, group="model", order="ordinal")


POINTER = "ordinal LONG, version STRING, model_name STRING"


def save(spark: SparkSession, model: PipelineModel, name: str, out: str,
         metrics: DataFrame | None = None, version: str | None = None) -> str:
    """Publish a model; returns its version.

    Model and metadata (name, features) are written aside, under
    ``out/versions/<version>``; then one small pointer row makes it the current
    one. A save that breaks off leaves the model before it in place. The
    metrics of every candidate are kept with the version.
    """
    version = version or uuid.uuid4().hex
    at = f"{out}/versions/{version}"
    model.write().overwrite().save(f"{at}/model")
    info = {"model_name": name, "feature_count": len(FEATURE_NAMES), "feature_names": FEATURE_NAMES, "version": version}
    spark.createDataFrame([(json.dumps(info),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{at}/model_info")
    if metrics is not None:
        (metrics.select(F.col("model").alias("model_name"), "accuracy", "precision", "recall", "f1_score",
                        F.current_timestamp().alias("training_date"), F.lit(version).alias("model_version"))
         .coalesce(1).write.mode("overwrite").parquet(f"{out}/model_metrics/model_version={version}"))
    n = read_parts(spark, f"{out}/current", POINTER).count()
    spark.createDataFrame([(n, version, name)], POINTER).coalesce(1).write.mode("append").parquet(f"{out}/current")
    return version


def load(spark: SparkSession, out: str, version: str | None = None) -> tuple[PipelineModel, dict]:
    """The current model, or one version, and its metadata. A model of other
    features than these is refused."""
    if version is None:
        last = read_parts(spark, f"{out}/current", POINTER).orderBy(F.desc("ordinal")).first()
        if last is None:
            raise ValueError(f"no published model under {out}")
        version = last.version
    at = f"{out}/versions/{version}"
    info = json.loads(spark.read.text(f"{at}/model_info").first()[0])
    if info["feature_names"] != FEATURE_NAMES:
        raise ValueError(f"version {version} was trained on other features")
    return PipelineModel.load(f"{at}/model"), info


RESULT = "seed INT, model STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1_score DOUBLE, error STRING"
SIDE_BY_SIDE = 4  # fits of the grid that run at once


def experiments(spark: SparkSession, corpus: DataFrame, key: str, seeds=(0, 1, 2, 3, 4),
                learners=LEARNERS, rounds: int = 200, out: str | None = None) -> DataFrame:
    """Metrics per (seed, model) with library-default settings on all rows.

    The corpus is featurised once, with the side each seed puts a row on as a
    column of its own. Fits run side by side, in a scheduler pool each, so
    short jobs of one fill the gaps of another. Each result is stored under
    ``out``: a grid that broke off goes on with what is missing. A learner that
    rejects its input is recorded with its error instead of a score. Failures
    of the cluster are not: they raise.
    """
    out = out or shared_path(spark, "experiments")
    found = _stored(spark, f"{out}/results")
    todo = [(seed, name) for seed in seeds for name in learners if (seed, name) not in found]
    if todo:
        split, narrow = corpus.select(key, "query", "label"), written(corpus.select(key, "label"), "experiment-keys")
        for seed in seeds:
            cuts = cut_hashes(narrow, key, "label", 0.2, seed).collect()  # a row per label, and there are two
            split = split.withColumn(f"is_test_{seed}", _is_test(cuts, key, seed))
        sides = [f"is_test_{s}" for s in seeds]
        data = written(prepare(spread(split), keep=[key, *sides]).select(key, "label", *sides, "features"),
                       "experiment-features")
        with ThreadPool(min(SIDE_BY_SIDE, len(todo))) as pool:
            pool.map(inheritable_thread_target(spark)(lambda job: _one_fit(data, *job, rounds, out)), todo, chunksize=1)
    rows = [r for job, r in sorted(_stored(spark, f"{out}/results").items()) if job[0] in seeds and job[1] in learners]
    return spark.createDataFrame(rows, RESULT)


def _is_test(cuts, key: str, seed: int):
    """The cut of ``stratified_split`` as a condition on the row itself."""
    out = F.lit(False)
    for value, cut_hash in cuts:
        out = F.when(F.col("label") == value, seeded_hash(F.col(key), seed) <= cut_hash).otherwise(out)
    return out


def _one_fit(data: DataFrame, seed: int, name: str, rounds: int, out: str) -> None:
    spark = data.sparkSession
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{name}-{seed}")
    spark.sparkContext.setLocalProperty(trees.SIDE_BY_SIDE, str(SIDE_BY_SIDE))
    side = F.col(f"is_test_{seed}")
    train, test = data.where(~side), data.where(side)
    try:
        model = fit(name, train, train.count(), seed, defaults=True, rounds=rounds)
        m = binary_metrics(predictions(model, test, name), group="model").first()
        row = (seed, name, m["accuracy"], m["precision"], m["recall"], m["f1_score"], None)
    except IllegalArgumentException as e:
        row = (seed, name, None, None, None, None, f"{type(e).__name__}: {e}")
    spark.createDataFrame([row], RESULT).coalesce(1).write.mode("overwrite").parquet(f"{out}/results/{name}-{seed}")


def _stored(spark: SparkSession, path: str) -> dict[tuple, tuple]:
    """(seed, model) → row of the results that are complete."""
    rows = read_parts(spark, path, RESULT).collect()  # a row per fit
    return {(r.seed, r.model): tuple(r) for r in rows}


def train_job(spark: SparkSession, out: str, path: str | None = None, fmt: str = "csv",
              texts: DataFrame | None = None, text: str = "text", feedback: DataFrame | None = None,
              learners=LEARNERS, test_size: float = 0.2, seed: int = 42, rounds: int = 200,
              version: str | None = None) -> DataFrame:
    """Load (or augment) → features → split → fit all → evaluate → keep the best.

    ``feedback`` (query, label) rows from analysts join the corpus, for
    retraining. Writes the winning pipeline, its metadata and every candidate's
    metrics under ``out``; returns the metrics frame.
    """
    from ..sources.corpus import load_corpus
    corpus, _rejects = load_corpus(spark, path, fmt, texts=texts, text=text, key="id", seed=seed)
    corpus = with_feedback(corpus, feedback) if feedback is not None else corpus
    metrics, models, _ = train_evaluate(spark, corpus, "id", learners, test_size, seed, rounds=rounds)
    best = select_best(metrics).first()["model"]
    save(spark, models[best], best, out, metrics, version)
    return spark.read.parquet(f"{out}/model_metrics")


def with_feedback(corpus: DataFrame, feedback: DataFrame) -> DataFrame:
    """The (id, query, label) corpus and the analysts' (query, label) rows."""
    own = feedback.select(F.concat(F.lit("feedback-"), F.xxhash64("query", "label").cast("string")).alias("id"),
                          "query", F.col("label").cast("int").alias("label"))
    return corpus.select(F.col("id").cast("string").alias("id"), "query", "label").unionByName(own)

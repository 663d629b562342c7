"""Training, selection, persistence, model-backed verdicts and streaming."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators.score import ModelScorer, screen
from sievekit.plans import ml
from sievekit.sources import tables as T

REFERENCE_CASES = [
    ("SELECT * FROM users WHERE id = 1", False),
    ("admin' OR '1'='1", True),
    ("'; DROP TABLE users --", True),
    ("SELECT name, email FROM customers", False),
    ("' UNION SELECT NULL, NULL, NULL --", True),
    ("https://google.com/search?q=test", False),
    ("http://example.com/page?id=1' OR '1'='1", True),
]


@pytest.fixture(scope="module")
def trained(spark):
    corpus = T.requests(spark, "/root/testdata/sf0.001").select("request_id", "query", "label")
    metrics, models, _ = ml.train_evaluate(spark, corpus, "request_id",
                                           learners=["LogisticRegression", "RandomForest"])
    return metrics, models


def test_metrics_floor_and_selection(trained):
    metrics, _ = trained
    rows = {r["model"]: r for r in metrics.collect()}
    assert set(rows) == {"LogisticRegression", "RandomForest"}
    assert all(r["f1_score"] >= 0.95 for r in rows.values())
    best = ml.select_best(metrics).first()
    assert best["model"] in rows


def test_reference_verdicts_with_model(spark, trained):
    _, models = trained
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(REFERENCE_CASES)],
                               "request_id INT, query STRING")
    v = {r["request_id"]: r for r in
         screen(df, scorer=ModelScorer(models["RandomForest"]), carry=["request_id"]).collect()}
    for i, (q, inj) in enumerate(REFERENCE_CASES):
        assert v[i]["is_sql_injection"] == inj, q
    assert v[6]["vulnerable_parameter"] == "id"


def test_save_and_load(spark, trained, tmp_path):
    metrics, models = trained
    out = str(tmp_path / "model")
    ml.save(spark, models["LogisticRegression"], "LogisticRegression", out, metrics, "v1")
    model, info = ml.load(spark, out)
    assert info["model_name"] == "LogisticRegression" and info["feature_count"] == 144
    assert spark.read.parquet(out + "/model_metrics").count() == 2


def test_svm_rff_has_probabilities(spark):
    corpus = T.requests(spark, "/root/testdata/sf0.001").select("request_id", "query", "label").where("request_id < 600")
    metrics, models, data = ml.train_evaluate(spark, corpus, "request_id", learners=["SVM_rff"])
    gamma = models["SVM_rff"].stages[1].getOrDefault("gamma")
    assert 1 / 144 < gamma <= 1  # constant columns do not count
    p = models["SVM_rff"].transform(data).select(F.col("probability")).first()[0]
    assert abs(sum(p) - 1.0) < 1e-9
    assert metrics.first()["f1_score"] > 0.9


def test_model_screens_every_row_once(spark, trained):
    rows = [(1, "http://h/p?a=x y&b=' OR 1=1 --&b=z z"), (1, "http://h/p?a=x y"), (None, "' OR '1'='1"), (None, None),
            (2, "http://h/p?id=7"), (2, "http://h/p")]
    v = screen(spark.createDataFrame(rows, "request_id INT, query STRING"),
               scorer=ModelScorer(trained[1]["LogisticRegression"])).collect()
    assert sorted(str((r.request_id, r.query)) for r in v) == sorted(str(r) for r in rows)
    by_text = {r.query: r for r in v}
    assert by_text[rows[0][1]].params_scored == 3 and by_text[rows[1][1]].params_scored == 1
    assert by_text[rows[0][1]].vulnerable_parameter in ("a", "b") and by_text[rows[4][1]].params_scored == 0


def test_rejected_input_is_recorded_and_other_errors_raise(spark, monkeypatch):
    from pyspark.errors import IllegalArgumentException
    corpus = T.requests(spark, "/root/testdata/sf0.001").select("request_id", "query", "label")

    def refuse(*a, **k):
        raise IllegalArgumentException("no " * 400)

    monkeypatch.setattr(ml, "fit", refuse)
    r = ml.experiments(spark, corpus, "request_id", seeds=(0,), learners=["RandomForest"]).first()
    assert r["accuracy"] is None and len(r["error"]) > 1000

    def break_(*a, **k):
        raise RuntimeError("lost")

    monkeypatch.setattr(ml, "fit", break_)
    with pytest.raises(RuntimeError):
        ml.experiments(spark, corpus, "request_id", seeds=(0,), learners=["RandomForest"])


def test_grid_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    """Features are made once; stored results are not fitted again; sides are those of the split."""
    from sievekit.operators.split import stratified_split
    corpus = T.requests(spark, "/root/testdata/sf0.001").select("request_id", "query", "label")
    out, calls, real = str(tmp_path / "grid"), [], ml.fit
    prepared = []
    monkeypatch.setattr(ml, "prepare", lambda *a, f=ml.prepare, **k: prepared.append(1) or f(*a, **k))

    def watched(name, train, n_train, seed=42, *_, **_k):
        calls.append((seed, name))
        want = stratified_split(corpus, "request_id", "label", 0.2, seed).where("NOT is_test")
        assert train.select("request_id").exceptAll(want.select("request_id")).isEmpty() and n_train == want.count()
        return real(name, train, n_train, seed, defaults=True, rounds=2)

    monkeypatch.setattr(ml, "fit", watched)
    monkeypatch.setattr(ml, "SIDE_BY_SIDE", 1)
    grid = dict(seeds=(0, 1), learners=["LogisticRegression", "XGBoost_gbt"], out=out)
    with pytest.raises(RuntimeError):
        monkeypatch.setattr(ml, "fit", lambda name, *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
                            if name == "XGBoost_gbt" else watched(name, *a, **k))
        ml.experiments(spark, corpus, "request_id", **{**grid, "seeds": (0,)})
    assert calls == [(0, "LogisticRegression")]
    calls.append("resumed")
    monkeypatch.setattr(ml, "fit", watched)
    rows = ml.experiments(spark, corpus, "request_id", **grid).collect()
    assert sorted(calls[2:]) == [(0, "XGBoost_gbt"), (1, "LogisticRegression"), (1, "XGBoost_gbt")]
    assert len(prepared) == 2 and len(rows) == 4 and all(r.accuracy > 0.9 for r in rows)
    calls.append("again")
    assert ml.experiments(spark, corpus, "request_id", **grid).count() == 4 and calls[-1] == "again" and len(prepared) == 2


def test_published_versions(spark, trained, tmp_path):
    """The last published model is current; a broken save leaves it; other features are refused."""
    out, models = str(tmp_path / "published"), trained[1]
    with pytest.raises(ValueError, match="no published"):
        ml.load(spark, out)
    for version in ("a", "b", "a"):
        ml.save(spark, models["LogisticRegression"], f"LR-{version}", out, version=version)
        assert ml.load(spark, out)[1]["model_name"] == f"LR-{version}"
    models["LogisticRegression"].write().overwrite().save(f"{out}/versions/c/model")  # breaks off before its pointer
    assert ml.load(spark, out)[1]["version"] == "a" and ml.load(spark, out, "b")[1]["version"] == "b"
    import json
    spark.createDataFrame([(json.dumps({"feature_names": ["x"]}),)], "value STRING").coalesce(1).write.mode(
        "overwrite").text(f"{out}/versions/b/model_info")
    with pytest.raises(ValueError, match="other features"):
        ml.load(spark, out, "b")


def test_retraining_with_feedback(spark, tmp_path):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    feedback = spark.createDataFrame([("feedback text", 1), ("' OR 1=1", 1)], "query STRING, label INT")
    m = ml.train_job(spark, str(tmp_path / "out"), texts=texts, feedback=feedback, learners=["LogisticRegression"])
    assert m.count() == 1
    assert ml.load(spark, str(tmp_path / "out"))[1]["model_name"] == "LogisticRegression"


def test_stream_daily_equals_batch(spark):
    from sievekit.plans.catalog import QUERIES
    from sievekit.operators.logs import daily_statistics
    s = {r["date"]: (r["total_queries"], r["sql_injections_detected"])
         for r in QUERIES["stream_daily"](spark, "/root/testdata/sf0.001").collect()}
    lg = T.query_logs(spark, "/root/testdata/sf0.001")
    b = {r["date"]: (r["total_queries"], r["sql_injections_detected"])
         for r in daily_statistics(lg, lg.limit(0).withColumn("feedback_type", F.lit("x"))).collect()}
    assert s == b


def test_stream_daily_backlog_of_overlapping_files(spark, tmp_path):
    """One file a batch, the newest days first: no row is late."""
    import os
    from sievekit.operators.logs import daily_statistics
    from sievekit.streaming.jobs import run_daily_counter_stream
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in range(4):  # every file spans all days but the last ones
        part = events.where(F.col("event_id") % 4 == n)
        days = [r[0] for r in part.select(F.to_date("ts")).distinct().orderBy(F.desc(F.to_date("ts"))).collect()]
        part.where(F.to_date("ts") <= F.lit(days[n])).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        source = next((tmp_path / f"w{n}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        to = tmp_path / "in" / f"events-{n}.parquet"
        to.write_bytes(source.read_bytes())
        os.utime(to, (1_700_000_000 + n, 1_700_000_000 + n))
    got = {r["date"]: (r["total_queries"], r["sql_injections_detected"]) for r in
           spark.read.parquet(run_daily_counter_stream(spark, str(tmp_path / "in"), max_files=1)).collect()}
    logs = T.logs_from_requests(T.requests_from_events(spark, spark.read.parquet(str(tmp_path / "in"))))
    want = {r["date"]: (r["total_queries"], r["sql_injections_detected"])
            for r in daily_statistics(logs, logs.limit(0).withColumn("feedback_type", F.lit("x"))).collect()}
    assert len(want) > 3 and got == want


def test_late_rows_have_a_table(spark, tmp_path):
    """Files in falling order of time: what is over a day behind is late, and counted + late = all."""
    import os
    from sievekit.streaming.jobs import daily_totals, run_late_table_stream
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    days = [r[0] for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy(F.desc("d")).collect()]
    (tmp_path / "in").mkdir()
    parts = [F.to_date("ts") == F.lit(days[1]), F.to_date("ts") == F.lit(days[0]), F.to_date("ts") < F.lit(days[1])]
    for n, part in enumerate(parts):
        events.where(part).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        to = tmp_path / "in" / f"events-{n}.parquet"
        to.write_bytes(next((tmp_path / f"w{n}").glob("part-*.parquet")).read_bytes())
        os.utime(to, (1_700_000_000 + n, 1_700_000_000 + n))
    base = run_late_table_stream(spark, str(tmp_path / "in"), max_files=1)
    got = {r.date: (r.total_queries, r.late_rows) for r in daily_totals(spark, base).collect()}
    newest = events.where(parts[0] | parts[1]).agg(F.max("ts")).first()[0]
    bound = F.lit(newest) - F.expr("INTERVAL 1 DAY")
    late = parts[2] & (F.col("ts") < bound)
    want = {r.d: (r.n - r.late, r.late) for r in events.groupBy(F.to_date("ts").alias("d")).agg(
        F.count("*").alias("n"), F.count_if(late).alias("late")).collect()}
    assert got == want and sum(x for _, x in want.values()) > 0


def test_training_uses_all_cores(spark):
    """A corpus that comes in one part is featurised over all cores, and only what fits read is stored."""
    corpus = T.requests(spark, "/root/testdata/sf0.001").select("request_id", "query", "label").where("request_id < 300")
    _, _, data = ml.train_evaluate(spark, corpus.coalesce(1), "request_id", learners=["LogisticRegression"])
    files = {r[0] for r in data.select(F.input_file_name()).distinct().collect()}
    assert len(files) > 1 and data.count() == 300
    assert set(data.columns) == {"request_id", "label", "is_test", "features"}


def test_registered_experiments_run_all_rounds(spark, monkeypatch):
    """Every seed and learner is fitted with the 200 rounds of the whole job."""
    from sievekit.plans.catalog import QUERIES
    calls, corpora = [], T.requests(spark, "/root/testdata/sf0.001").where("request_id < 60")
    monkeypatch.setattr(T, "requests", lambda *_: corpora)
    monkeypatch.setattr(ml, "prepare", lambda df, keep: df.select(*keep, "label", F.lit(0).alias("features")))

    def watched(name, train, n_train, seed=42, defaults=False, rounds=200):
        calls.append((seed, name, defaults, rounds))
        raise ml.IllegalArgumentException("not fitted here")

    monkeypatch.setattr(ml, "fit", watched)
    rows = QUERIES["experiments"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(calls) == sorted((seed, name, True, 200) for seed in range(5) for name in ml.LEARNERS)
    assert all(r.n_failed == 5 for r in rows)

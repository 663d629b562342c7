"""Batches that a retry cannot double, touched days, the log bucketed by id."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators import logs as LG
from sievekit.operators import store as ST
from sievekit.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return T.query_logs(spark, SF).cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_same_batch_twice_gives_one_copy(spark, logs, tmp_path):
    path = str(tmp_path / "log")
    assert ST.append_batch(logs, path, "a") and not ST.append_batch(logs, path, "a")
    assert ids(ST.read_log(spark, path)) == ids(logs)
    assert ST.commits(spark, path).first().n_rows == logs.count()


def test_half_written_batch_is_invisible(spark, logs, tmp_path):
    path = str(tmp_path / "log")
    ST.append_batch(logs.where("id % 2 = 0"), path, "a")
    ST.stage_batch(logs.where("id % 4 = 1"), path, "b")  # the job breaks off here
    assert ids(ST.read_log(spark, path)) == ids(logs.where("id % 2 = 0"))
    ST.append_batch(logs.where("id % 2 = 1"), path, "b")  # and is run again
    assert ids(ST.read_log(spark, path)) == ids(logs)


def test_columns_and_days_stay(spark, logs, tmp_path):
    path = str(tmp_path / "log")
    ST.append_batch(logs, path, "0")
    got = ST.read_log(spark, path)
    assert set(got.columns) == {*logs.columns, "log_date", "batch"}
    assert got.select(logs.columns).exceptAll(logs).isEmpty()
    week = LG.last_days(got, 7, LG.newest(got))
    assert "PartitionFilters: [isnotnull(log_date" in week._jdf.queryExecution().executedPlan().toString()
    assert week.count() == LG.last_days(logs, 7, LG.newest(logs)).count()


def test_empty_batch(spark, logs, tmp_path):
    path = str(tmp_path / "log")
    ST.append_batch(logs, path, "a")
    schema = spark.read.parquet(f"{path}/data").schema
    ST.append_batch(logs.where("false"), path, "b")
    assert ids(ST.read_log(spark, path, schema)) == ids(logs)


def test_rollup_reads_and_writes_touched_days_only(spark, logs, tmp_path, monkeypatch):
    paths = [str(tmp_path / n) for n in ("log", "feedback", "daily")]
    marks = T.feedback_from_logs(logs)
    days = [r[0] for r in logs.select(F.to_date("created_at")).distinct().orderBy(F.col("to_date(created_at)")).collect()]
    day = F.to_date("created_at")
    ST.append_batch(logs.where(day != days[3]), paths[0], "a")
    ST.append_batch(marks.where(day != days[3]), paths[1], "a")
    assert ST.roll_up(spark, *paths) == [d for d in days if d != days[3]]
    assert ST.roll_up(spark, *paths) == []  # nothing new
    first = {r.date: r.updated_at for r in spark.read.parquet(f"{paths[2]}/data").collect()}
    ST.append_batch(logs.where(day == days[3]), paths[0], "b")
    plans = []
    real = ST.daily_statistics

    def watched(lg, fb):
        plans.append(lg._jdf.queryExecution().executedPlan().toString())
        return real(lg, fb)

    monkeypatch.setattr(ST, "daily_statistics", watched)
    assert ST.roll_up(spark, *paths) == [days[3]]
    assert "PartitionFilters" in plans[0] and str(days[3]) in plans[0].split("PartitionFilters")[1][:400] or "log_date" in plans[0]
    after = {r.date: r for r in spark.read.parquet(f"{paths[2]}/data").collect()}
    assert {d for d, r in after.items() if first.get(d) != r.updated_at} == {days[3]}
    kept = marks.where(day != days[3])  # the last day's feedback never came
    want = {r.date: r for r in real(logs, kept).collect()}
    for d, r in after.items():
        assert [r[c] for c in want[d].asDict()] == list(want[d])


def test_join_by_id_shuffles_the_feedback_only(spark, logs, tmp_path):
    table = ST.by_id(logs, "bucketed_logs_of_a_test", str(tmp_path / "by_id"), buckets=8)
    marks = T.feedback_from_logs(logs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = LG.feedback_join(marks, table)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(str, joined.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_logs_of_a_test")
    assert plan.count("Exchange hashpartitioning") == 1 and "query_log_id" in plan.split("Exchange hashpartitioning")[1][:30]
    assert rows == sorted(map(str, LG.feedback_join(marks, logs).collect()))

"""Log store: day partitions, pruning, anchors; shared folders."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sievekit import session
from sievekit.operators import logs as LG
from sievekit.operators import triage as TR
from sievekit.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logs") / "query_logs")
    LG.append_table(T.query_logs(spark, SF), path)
    return path


def test_only_the_days_asked_for_are_read(spark, stored):
    logs = spark.read.parquet(stored)
    week = LG.last_days(logs, 7, LG.newest(logs))
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    days = week.select("log_date").distinct().count()
    assert days <= 8 < logs.select("log_date").distinct().count()
    assert week.count() == LG.last_days(T.query_logs(spark, SF), 7, LG.newest(T.query_logs(spark, SF))).count()


def test_append_twice_doubles(spark, tmp_path):
    path = str(tmp_path / "feedback")
    for _ in range(2):
        LG.append_table(T.feedback_logs(spark, SF), path)
    assert spark.read.parquet(path).count() == 2 * T.feedback_logs(spark, SF).count()


def test_export_quotes(spark, tmp_path):
    logs = T.query_logs(spark, SF).limit(1).withColumn("query", F.lit('a "quoted", value\'s'))
    TR.write_export(TR.triage(logs), str(tmp_path / "x"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "x")).first()
    assert back["URL"] == 'a "quoted", value\'s'


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(cluster)

import math

import pytest

from pyspark.sql import functions as F

from sievekit.operators.split import stratified_split
from sievekit.sources import corpus as CO
from sievekit.sources import tables as T


def test_split_exact_counts_and_partition_independence(spark):
    r = T.requests(spark, "/root/testdata/sf0.001").select("request_id", "label")
    a = stratified_split(r, "request_id", "label", 0.2, 42)
    counts = {row["label"]: (row["n"], row["t"]) for row in
              a.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    for n, t in counts.values():
        assert t == math.ceil(n * 0.2)
    # a tiny bucket width forces many straddling-free buckets; same answer
    b = stratified_split(r.repartition(7), "request_id", "label", 0.2, 42, bucket_hex=1)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_augment_is_deterministic_and_balanced(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    key = F.concat_ws("-", "conv_id", "turn")
    a = CO.augment(texts, key, "text", seed=7)
    b = CO.augment(texts.repartition(5), key, "text", seed=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert 0.4 < a.agg(F.avg("label")).first()[0] < 0.6
    pair = a.join(texts.select(key.alias("key"), "text"), "key")
    assert pair.where("label = 1 AND NOT contains(query, text)").isEmpty()
    assert pair.where("label = 1").select("tid").distinct().count() > 25


def test_equal_keys_stay_together(spark):
    df = spark.range(500).select((F.col("id") % 100).alias("k"), (F.col("id") % 2).cast("int").alias("label"))
    split = stratified_split(df, "k", "label", 0.2, 1)
    assert split.count() == 500 and split.groupBy("k").agg(F.countDistinct("is_test").alias("n")).where("n > 1").isEmpty()
    assert stratified_split(df.limit(0), "k").count() == 0


def test_labelled_csv_resolution_and_rejects(spark, tmp_path):
    path = str(tmp_path / "train.csv")
    with open(path, "w") as fh:
        fh.write('id,Payload,Class,label_text\n1,"a, ""quoted"" value",unsafe,x\n'
                 "2,SELECT 1,normal,x\n3,x,maybe,x\n4,y,1,x\n")
    good, bad = CO.read_labelled(spark, path)
    assert sorted(map(tuple, good.collect())) == [('SELECT 1', 0), ('a, "quoted" value', 1), ("y", 1)]
    assert [tuple(r) for r in bad.collect()] == [("x", "maybe")]
    assert CO.resolve_columns(["Text", "text", "Target"]) == ("text", "Target")
    assert CO.resolve_columns(["body", "y"]) == (None, None)


def test_a_given_file_is_never_replaced(spark, tmp_path):
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        CO.load_corpus(spark, str(tmp_path / "missing.csv"))
    path = tmp_path / "odd.csv"
    path.write_text("body,y\na,1\n")
    with pytest.raises(ValueError, match="no text and label column"):
        CO.load_corpus(spark, str(path))
    with pytest.raises(ValueError):
        CO.load_corpus(spark)
    texts = spark.createDataFrame([("a1",), ("b2",), (None,)], "text STRING")
    corpus, rejects = CO.load_corpus(spark, texts=texts)
    assert rejects is None and corpus.count() == 3

import math
from collections import defaultdict

from pyspark.sql import functions as F

from llm_helpers import CLASHING, rows_of
from sievekit.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    left = budget * total
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] <= level * w[s]}
        if not full:
            target.update({s: level * w[s] for s in open_})
            break
        target.update({s: float(cap * sizes[s]) for s in full})
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def check(df):
    rows = mixing.mix_report(df).join(df.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    target = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s], (s, taken[s], target[s])
    return rows


def test_targets_and_taken(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(df)


def test_one_source_holds_most(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a "), F.repeat(F.lit("b "), (F.col("id") % 40).cast("int"))).alias("text"),
                                  F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    first = check(df)
    again = mixing.mix_report(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def test_edge_rows_and_mixed_corpus(spark, edge_docs):
    report = mixing.mix_report(edge_docs)
    assert report.count() == edge_docs.count()
    assert report.where("size = 0 AND taken > 0").isEmpty()
    mixed = mixing.mix(edge_docs)
    assert mixed.dtypes == edge_docs.dtypes
    words = mixed.select(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == report.agg(F.sum("taken")).first()[0]
    assert mixed.where(" OR ".join(f"`{c}` <> 'own-{c}'" for c in CLASHING)).isEmpty()


def test_empty_table(spark, no_docs):
    assert mixing.mix_report(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_all_texts_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert rows_of(mixing.mix_report(df), "doc_id", "size", "target", "taken") == ["(1, 0, 0.0, 0)", "(2, 0, 0.0, 0)"]

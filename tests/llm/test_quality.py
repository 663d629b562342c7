import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_helpers import edge_rows, rows_of
from sievekit.llm import quality_classifier as qc
from sievekit.llm import quality_rules as qr

SF = "/root/testdata/sf0.01"


def brute_counters(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


COUNTERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counters_of_documents(spark, tables):
    texts = dict(tables[0].select("doc_id", "text").collect())
    for r in qr.judge(*tables).collect():
        assert tuple(r[c] for c in COUNTERS) == brute_counters(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.probability >= qr.KEEP_AT)


def test_rules_agree_with_labels(tables):
    rows = qr.judge(*tables).join(tables[1], "doc_id").where("NOT base_failed").collect()
    right = [r.kept == bool(r.quality) for r in rows]
    assert sum(right) >= 0.98 * len(right)
    assert all(r.kept for r in rows if r.quality)  # clean documents stay


def test_probability_is_calibrated(tables):
    rows = qr.judge(*tables).join(tables[1], "doc_id").collect()
    assert abs(np.mean([r.probability for r in rows]) - np.mean([r.quality for r in rows])) < 0.05


def test_rules_on_edge_rows(edge_docs, no_docs, no_labels, tables):
    got = qr.judge(edge_docs, no_labels).collect()
    want = [str((i, *brute_counters(t))) for i, t in edge_rows()]
    assert sorted(str((r.doc_id, *(r[c] for c in COUNTERS))) for r in got) == sorted(want)
    assert all(r.kept == (not r.base_failed) and r.probability is None for r in got)
    kept = qr.keep(edge_docs, tables[1])
    assert kept.dtypes == edge_docs.dtypes
    assert rows_of(kept, "doc_id") == rows_of(qr.judge(edge_docs, tables[1]).where("kept"), "doc_id")
    assert qr.judge(no_docs, tables[1]).count() == 0 == qr.keep(no_docs, no_labels).count()


def test_labels_with_nulls_and_contradictions(spark, tables):
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0)], tables[1].schema)
    docs = tables[0].unionByName(tables[0].where("doc_id < 3"))  # repeated rows
    assert qr.judge(docs, tables[1].where("doc_id > 2").unionByName(odd)).count() == docs.count()
    assert qc.score(docs, tables[1].where("doc_id > 2").unionByName(odd)).count() == docs.count()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_classifier_on_held_out_rows(tables):
    rows = qc.score(*tables).join(tables[1], "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.97
    low = max(r.score for r in out if not r.quality)
    assert np.mean([r.score > low for r in out if r.quality]) >= 0.95


def test_classifier_never_sees_held_out_labels(tables):
    docs, labels = tables
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1,
                                                  1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(qc.score(docs, labels)) == rows_of(qc.score(docs, flipped))


def test_classifier_on_edge_rows(edge_docs, no_docs, no_labels, tables):
    got = qc.score(edge_docs, tables[1])
    assert got.count() == len(edge_rows()) and got.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert {r.score for r in qc.score(edge_docs, no_labels).collect()} == {0.5}
    assert qc.score(no_docs, tables[1]).count() == 0


def test_contexts_match_a_loop():
    texts = ["a b c a b", "", "b c", None, "one"]
    contexts = qc.Contexts()
    *both, doc = qc.streams(texts)
    contexts.add(both, doc)
    assert doc.tolist() == [0] * 5 + [2] * 2 + [4]
    want = np.zeros((qc.WORD_BUCKETS, qc.DIMS))
    for t in texts:
        ids = qc.streams([t])[0]
        for i, w in enumerate(ids):
            for d in (-2, -1, 1, 2):
                if 0 <= i + d < len(ids):
                    plus, minus = qc.PLACES[0][ids[i + d]]
                    want[w, plus] += 1
                    want[w, minus] -= 1
    assert np.array_equal(contexts.sums[0].reshape(-1, qc.DIMS), want)


def test_shapes():
    raw = "Thre*** EDTH!!\té1234\n\n||".encode()
    assert qc.shapes(np.frombuffer(raw, np.uint8)).tobytes() == b"Aa* A! a0 |"
    _, forms, _ = qc.streams(["Abc! x Zed! y", "Q!"])
    assert forms[0] == forms[2] and forms[1] == forms[3] and forms[4] != forms[0]

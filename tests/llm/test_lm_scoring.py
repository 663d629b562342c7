import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_helpers import edge_rows
from sievekit.llm import lm_scoring as lm


def brute(rows):
    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 1

    uni, pairs, history, followers = Counter(), Counter(), Counter(), Counter()
    split = [(t or "").encode().lower().split() for _, t in rows]
    for (i, _), w in zip(rows, split):
        if not held(i):
            uni.update([*w, "end"])
            pairs.update(zip(["start", *w], [*w, "end"]))
    for (a, _), c in pairs.items():
        history[a] += c
        followers[a] += 1
    n, v = sum(uni.values()), len(uni)
    once, twice = (sum(c == k for c in pairs.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once else 0.5
    out = []
    for (i, _), w in zip(rows, split):
        base = score = 0.0
        for a, b in zip(["start", *w], [*w, "end"]):
            p = (uni[b] + 0.5) / (n + 0.5 * (v + 1))
            left = d * followers[a] / history[a] if history[a] else 1.0
            base += math.log10(p)
            score += math.log10((max(pairs[a, b] - d, 0) / history[a] if pairs[a, b] else 0) + left * p)
        out.append((i, held(i), len(w) + 1, sum(uni[b] > 0 for b in [*w, "end"]), n, base, score))
    return out


def check(df, rows):
    key = lambda x: (str(x[:5]), round(x[5], 4), round(x[6], 4))
    got, want = sorted(map(tuple, lm.lm_score(df).collect()), key=key), sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9), (g, w)
    return got


@pytest.mark.parametrize("size", [1 << 23, 3000])
def test_edge_rows(edge_docs, monkeypatch, size):
    """Small chunks and parts: many blocks, long documents in chunks of their own."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", size)
    monkeypatch.setattr(lm, "PART_BYTES", 4 * size)
    check(edge_docs, edge_rows())


def test_documents_beat_unigrams(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = check(df, rows)
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])


def test_weights_out_of_a_state_sum_to_one():
    import numpy as np
    counts = np.array([[0, 3, 1, 0], [2, 0, 0, 5], [0, 0, 0, 0], [1, 1, 1, 1]])
    n = counts.shape[0]
    share = np.array([0.4, 0.3, 0.2, 0.1])
    model = lm.Automaton(n, np.arange(n * n), counts.ravel(), counts.sum(1), (counts > 0).sum(1), share, 0.6)
    steps = [model.traverse(np.array([a * n + b]), np.array([1]))[0] for a in range(n) for b in range(n)]
    assert np.allclose((10 ** np.array(steps)).reshape(n, n).sum(1), 1)


def test_nothing_to_train_on(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [(i, "a b") for i in held]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_frequent_word(spark):
    """Two thirds of the words are one word, which every other word follows."""
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.lit("the the w"), (F.col("id") * k % 97).cast("string")))).alias("text"))
    check(df.repartition(5), [tuple(r) for r in df.collect()])


def test_empty_table(no_docs):
    assert lm.lm_score(no_docs).count() == 0

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_helpers import edge_rows
from sievekit.llm import near_dedup as nd
from sievekit.llm.components import components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k=4, percent=80):
    """(doc_id, set size, component_id, kept) by comparing sets that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for n, s in enumerate(sets):
        for m, common in Counter(m for x in s for m in where[x]).items():
            if 100 * common >= percent * (len(s) + len(sets[m]) - common):
                parent[root(n)] = root(m)
        for x in s:
            where[x].append(n)
    low = {}
    for n, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(n)] = min(doc_id, low.get(root(n), doc_id))
    out = []
    for n, (doc_id, _) in enumerate(rows):
        component = low.get(root(n)) if sets[n] else doc_id
        out.append(str((doc_id, len(sets[n]), component, doc_id == component)))
    return sorted(out)


def got_of(df, p=nd.Params()):
    return sorted(str(tuple(r)) for r in nd.near_dedup(df, p).collect())


def family(n, words, edits, seed):
    """Near copies of one text: many pairs lie close to the threshold."""
    draw = random.Random(seed)
    base = [f"f{seed}w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(words)] = f"e{draw.random()}"
        out.append(" ".join(own))
    return out


def test_edge_rows(edge_docs):
    assert got_of(edge_docs) == brute(edge_rows())


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert got_of(df) == brute([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("p", [nd.Params(), nd.Params(region=4, tile=8), nd.Params(region=1, tile=3, depth=2)])
def test_large_families(spark, p):
    """A third of the rows are near copies of one text; small limits force
    deeper regions, tiles and the spread-out path."""
    rows = family(150, 100, 4, 1) + family(30, 60, 3, 2) + [f"own{i} " * 3 + f"text{i} of its own {i}" for i in range(250)]
    rows = list(enumerate(rows))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_of(df, p) == brute(rows)


def test_hot_first_values(spark, monkeypatch):
    """Hot values go to full depth at once and are range-partitioned."""
    rows = list(enumerate(family(120, 80, 3, 4) + [f"r{i} s{i} t{i} u{i} v{i}" for i in range(60)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_of(df, nd.Params(region=2)) == brute(rows)


def test_one_row_of_each_component_stays(edge_docs, no_docs):
    p = nd.Params(words=5)
    kept = nd.keep_one(edge_docs, p)
    assert kept.dtypes == edge_docs.dtypes
    got = sorted(str(r.doc_id) for r in kept.select("doc_id").collect())
    want = [eval(x) for x in brute(edge_rows(), 5)]
    ids = {x[2] for x in want if x[1]}
    assert got == sorted([*map(str, ids), *(str(x[0]) for x in want if not x[1])])
    assert nd.keep_one(no_docs, p).count() == 0 == nd.near_dedup(no_docs).count()


def test_signature_estimates_similarity():
    a = nd.Shingler(4)(" ".join(f"w{i}" for i in range(500)))
    b = nd.Shingler(4)(" ".join(f"w{i}" for i in range(50, 550)))
    p = nd.Params(trees=100, depth=3)
    x, y = nd.minhash([a, b], p)
    common = len(np.intersect1d(a, b))
    assert abs((x == y).mean() - common / (len(a) + len(b) - common)) < 0.1
    one, two = nd.sketch(np.stack([x, y]))
    assert nd.agreeing(one, two[None], p.values)[0] == ((x & 15) == (y & 15)).sum()


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(90)] \
        + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    links = [(a, b) for a, b in links if a != b]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert {r.node: r.root for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)

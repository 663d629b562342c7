import math
import re
from collections import Counter

import numpy as np
import pytest

from llm_helpers import edge_rows
from sievekit.llm import ranked_search as rs

ITEMS = [(0, "alpha beta gamma"), (1, "Alpha ALPHA zeta7 zeta7"), (2, None), (3, ""), (4, "nowhere-to-be-found"),
         (5, "w1 w2 w3 w4 w59"), (6, "é à 日本語 ß"), (7, "long words"), (7, "long words"), (None, "one two"),
         (8, "x" * 300_000), (9, "!!! ***")]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                      re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(items, docs, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        scores.sort(key=lambda x: x[:3])
        out += [(item_id, r, s[3], -s[0]) for r, s in enumerate(scores[:k], 1)]
    return sorted(map(str, out))


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'own' score", "1 number", "2 rank")


@pytest.mark.parametrize("k", [1, 3, 20])
def test_edge_rows(spark, edge_docs, items, k):
    assert rows(rs.search(items, edge_docs, k)) == brute(ITEMS, edge_rows(), k)


def test_blocks_and_small_trees(spark, edge_docs, items, monkeypatch):
    monkeypatch.setattr(rs, "ITEMS", 3)
    monkeypatch.setattr(rs, "TREE", 5)
    monkeypatch.setattr(rs, "DOC_LEAF", 2)
    monkeypatch.setattr(rs, "ITEM_LEAF", 1)
    assert rows(rs.search(items, edge_docs, 2)) == brute(ITEMS, edge_rows(), 2)


def test_seeded_floors(spark, items, monkeypatch):
    """Floors from a sample change nothing, ties and repeated rows included."""
    docs = [(i % 170, " ".join(f"w{(i * j) % 23}" for j in range(1, 2 + i % 9))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = [(i, f"w{i} w{i + 1} w{2 * i} w{i}") for i in range(20)]
    monkeypatch.setattr(rs, "SEED_DOCS", 60)
    assert rows(rs.search(spark.createDataFrame(asked, "item_id long, text string"), df)) == brute(asked, docs)


def _vectors(seed, n, width, groups):
    draw = np.random.default_rng(seed)
    out = np.zeros((n, width), np.int64)
    for i in range(n):
        own = draw.integers(0, groups) * (width // groups)
        at = own + draw.integers(0, width // groups, 6)
        out[i, at] = draw.integers(1, 1000, 6)
    return out


@pytest.mark.parametrize("big", [1, 1 << 40])
def test_trees_equal_all_pairs_and_prune(big):
    """Exact below and beyond 2^53; whole batches are left out where groups differ."""
    docs, asked = _vectors(1, 3000, 160, 8), _vectors(2, 100, 160, 8) * big
    ids = np.random.default_rng(3).permutation(3000)
    sparse = rs.Rows.of(docs)
    best = rs.Best(100, 5, np.zeros(100, np.int64))
    tree = rs.item_tree(asked)
    leaf = tree
    while leaf.rows is None:
        leaf = leaf.left
    assert leaf.exact is (big == 1)
    scored = rs.search_trees(tree, rs.Node(rs._halves(sparse, 64, np.ones(160)), sparse), ids, best)
    all_scores = docs @ asked.T
    for i in range(100):
        order = np.lexsort((ids, -all_scores[:, i]))[:5]
        assert best.scores[i].tolist() == all_scores[order, i].tolist() and best.ids[i].tolist() == ids[order].tolist()
    assert scored < 0.4 * 3000 * 100


def test_bounds_hold():
    docs, asked = _vectors(4, 300, 40, 2), _vectors(5, 40, 40, 2)
    sparse = rs.Rows.of(docs)
    node, tree = rs.Node(rs._halves(sparse, 16, np.ones(40)), sparse), rs.item_tree(asked)
    scores = docs @ asked.T

    def below(x):
        return x.rows if x.rows is not None else np.concatenate([below(x.left), below(x.right)])

    def walk(a, b):
        assert scores[np.ix_(below(b), below(a))].max() <= a.top @ b.top[a.terms]
        for x in (a.left, a.right):
            if x is not None:
                walk(x, b)
        for x in (b.left, b.right):
            if x is not None:
                walk(a, x)

    walk(tree, node)


def test_no_rows(spark, no_docs, items, edge_docs):
    assert rs.search(items, no_docs).collect() == []
    empty = spark.createDataFrame([], "item_id long, text string")
    got = rs.search(empty, edge_docs)
    assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]

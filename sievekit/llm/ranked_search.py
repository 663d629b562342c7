"""Ranked lexical search: exact top-k of all documents for each item, dual-tree.

One pass over the documents keeps the counts of the terms that items ask for,
and the number of documents and terms (all documents, all terms). Those give
the integer weights, after which a document is a vector of term values and an
item a vector of term weights; the score is their product.

Both sides have a hierarchy: a node holds the largest value of each coordinate
below it. The product of two nodes' maxima bounds every score between them, so
a pair of nodes whose bound is below the weakest kth score of the items in it
is left out as a whole; what remains is split, the more promising half first,
until a batch of documents meets a batch of items in one matrix product.
Documents are dealt to trees of bounded size by Spark; each task keeps the best
k of each item over its trees, and a window over those few rows ranks them. A
first search over a bounded sample of documents gives every task a floor for
each kth score; it changes what is looked at, never the result.

Items are the query set, taken in blocks of about ``ITEMS``; only a block's
vectors travel with the tasks. Scores are whole numbers and exact: matrix
products run in doubles while every sum stays below 2^53, else in 64-bit
integers, and bounds get a margin above their rounding.

Defined results: NULL or empty text has no terms and is not counted; an item
without known terms has no rows; equal scores go by ascending doc_id, a NULL
doc_id last; repeated rows of either side count and rank as rows of their own;
extra columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ITEMS = 512              # items searched together, about
TREE = 4096              # documents of one tree, at most
DOC_LEAF, ITEM_LEAF = 64, 16
SEED_DOCS = 16_384       # documents of the first search, about
EXACT = 1 << 53
NO_ID = (1 << 63) - 1    # stands for a NULL doc_id, so that it sorts last
VECTORS = "doc_id long, n long, terms array<int>, counts array<long>, df array<long>"
FOUND = "item long, doc_id long, score long"

#: Bytes to bytes: digits, lower-cased A-Z, a-z and all bytes of other characters stay.
FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (lower-cased) and other characters."""
    return text.translate(FOLD).split() if text else []


def document_value(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Value of a term that occurs ``tf`` times in a document of length mark ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_mark(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 for a document of mean length, between 75 and what its length asks."""
    if len(n) and 25 * int(n.max()) * docs < 1 << 63:
        return 75 + (25 * n * docs) // total
    return np.array([75 + (25 * int(x) * docs) // total for x in n], np.int64)


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Rows:
    """Sparse non-negative vectors: terms and values of all rows, row after row."""

    def __init__(self, held: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int):
        """``held``: number of terms of each row."""
        self.starts, self.terms, self.values, self.width = np.append(0, np.cumsum(held)), terms, values, width

    def __len__(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of(cls, matrix: np.ndarray) -> "Rows":
        rows, terms = np.nonzero(matrix)
        return cls(np.bincount(rows, minlength=len(matrix)), terms, matrix[rows, terms], matrix.shape[1])

    def take(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the members, term, value) of all their terms."""
        held = self.starts[members + 1] - self.starts[members]
        at = np.repeat(self.starts[members] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        return np.repeat(np.arange(len(members)), held), self.terms[at], self.values[at]


def _spread(n: int, width: int, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place of each of ``n`` rows along about the direction in which they spread most."""
    mean = np.bincount(term, value, width) / n
    far = np.bincount(row, value * (value - 2 * mean[term]), n).argmax()
    along = np.bincount(term, value * (row == far), width) - mean
    for _ in range(4):
        place = np.bincount(row, value * along[term], n) - mean @ along
        along = np.bincount(term, value * place[row], width) - place.sum() * mean
        along /= np.abs(along).max(initial=0) or 1
    return np.bincount(row, value * along[term], n)


def _halves(rows: Rows, leaf: int, scale: np.ndarray):
    """Nested parts of the rows' numbers: a leaf is an array, an inner node a
    pair. A node is cut at the widest gap of its spread, a quarter of its rows
    or more on either side."""

    def halve(members):
        if len(members) <= leaf:
            return members
        row, term, value = rows.take(members)
        place = _spread(len(members), rows.width, row, term, value * scale[term])
        order = np.argsort(place, kind="stable")
        low = len(order) // 4
        gaps = np.diff(place[order])[low:len(order) - 1 - low]
        cut_at = low + 1 + int(gaps.argmax()) if gaps.max(initial=0) > 0 else len(order) // 2
        return halve(members[order[:cut_at]]), halve(members[order[cut_at:]])

    return halve(np.arange(len(rows)))


class Node:
    """Coordinate maxima of the rows below, and either two children or the rows
    with their (place, term, value)."""

    __slots__ = ("top", "left", "right", "rows", "held", "height")

    def __init__(self, part, rows: Rows):
        self.left = self.right = self.rows = self.held = None
        self.height = 0
        if isinstance(part, tuple):
            self.left, self.right = Node(part[0], rows), Node(part[1], rows)
            self.height = 1 + max(self.left.height, self.right.height)
            self.top = np.maximum(self.left.top, self.right.top)
        else:
            self.rows, self.held = part, rows.take(part)
            self.top = np.zeros(rows.width)
            np.maximum.at(self.top, self.held[1], self.held[2])


class ItemNode:
    """The same over items, on the terms that occur below only."""

    __slots__ = ("terms", "top", "left", "right", "rows", "values", "column", "height", "exact", "floor")

    def __init__(self, node: Node):
        self.terms, self.height = np.flatnonzero(node.top), node.height
        self.top = node.top[self.terms]
        self.left, self.right = (ItemNode(x) if x is not None else None for x in (node.left, node.right))
        self.rows, self.values, self.column, self.exact, self.floor = node.rows, None, None, True, 0
        if node.rows is not None:
            row, term, value = node.held
            self.column = np.full(len(node.top), -1)
            self.column[self.terms] = np.arange(len(self.terms))
            own = np.zeros((len(self.terms), len(node.rows)), np.int64)
            own[self.column[term], row] = value
            self.exact = int(own.sum(axis=0).max(initial=0)) * 1_000_000 < EXACT
            self.values = own.astype(np.float64) if self.exact else own

    def scores(self, docs: Node) -> np.ndarray:
        """Documents x items of two leaves."""
        row, term, value = docs.held
        at = self.column[term]
        own = np.zeros((len(docs.rows), len(self.terms)), self.values.dtype)
        own[row[at >= 0], at[at >= 0]] = value[at >= 0]
        return (own @ self.values).astype(np.int64)

    def settle(self, floors: np.ndarray) -> None:
        """Weakest kth score of the items below."""
        if self.rows is not None:
            self.floor = int(floors[self.rows].min())
        else:
            self.left.settle(floors)
            self.right.settle(floors)
            self.floor = min(self.left.floor, self.right.floor)


class Best:
    """The best k (score, doc_id) of each item, and the floor of its kth score."""

    def __init__(self, n_items: int, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors.copy()
        self.scores = [np.empty(0, np.int64)] * n_items
        self.ids = [np.empty(0, np.int64)] * n_items

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = scores >= max(1, self.floors[item])
        if not fit.any():
            return
        scores = np.concatenate([self.scores[item], scores[fit]])
        ids = np.concatenate([self.ids[item], ids[fit]])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.floors[item] = max(self.floors[item], int(self.scores[item][-1]))


def search_trees(items: ItemNode, docs: Node, ids: np.ndarray, best: Best) -> int:
    """Offer every pair whose bound reaches its floor; the number of pairs scored."""
    scored = 0

    def bound(a, b):
        return float(a.top @ b.top[a.terms]) * (1 + 1e-9)

    def visit(a, b, most):
        nonlocal scored
        if most <= 0 or most < a.floor:
            return
        if a.rows is not None and b.rows is not None:
            scores = a.scores(b)
            scored += scores.size
            own = ids[b.rows]
            for j, item in enumerate(a.rows):
                best.offer(int(item), scores[:, j], own)
            a.floor = int(best.floors[a.rows].min())
        elif b.rows is None and (a.rows is not None or b.height > a.height):
            for value, _, x in sorted(((bound(a, x), i, x) for i, x in enumerate((b.left, b.right))), reverse=True):
                visit(a, x, value)
        else:
            for x in (a.left, a.right):
                visit(x, b, bound(x, b))
            a.floor = min(a.left.floor, a.right.floor)

    visit(items, docs, bound(items, docs))
    return scored


def item_tree(vectors: np.ndarray) -> ItemNode:
    rows = Rows.of(vectors)
    return ItemNode(Node(_halves(rows, ITEM_LEAF, np.ones(rows.width)), rows))


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row (doc_id, n, terms, counts) for each document, and one with df for each task."""
    width = max(1, len(vocabulary))

    def run(batches):
        df, any_rows = np.zeros(width, np.int64), False
        step = max(1, min(512, (1 << 21) // width))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                tokens = [terms_of(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                n = np.array([len(x) for x in tokens], np.int64)
                known = np.fromiter((vocabulary.get(t, -1) for x in tokens for t in x), np.int64, int(n.sum()))
                cells = known + np.repeat(np.arange(len(n)) * width, n)
                counts = np.bincount(cells[known >= 0], minlength=len(n) * width)
                held = np.flatnonzero(counts)
                df += np.bincount(held % width, minlength=width)
                ends = np.append(0, np.cumsum(np.bincount(held // width, minlength=len(n)))).astype(np.int32)
                any_rows = True
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array((held % width).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(counts[held])),
                     pa.nulls(len(n), pa.list_(pa.int64()))],
                    names=["doc_id", "n", "terms", "counts", "df"])
        if any_rows:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())),
                 pa.nulls(1, pa.list_(pa.int64())), pa.array([df.tolist()], pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "counts", "df"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, VECTORS)


def _matches(vectors: DataFrame, items: ItemNode, scale: np.ndarray, n_items: int, floors: np.ndarray, k: int,
             n_docs: int, total: int) -> DataFrame:
    """(item, doc_id, score): the best k of each item over each task's documents."""
    def run(batches):
        best = Best(n_items, k, floors)
        items.settle(best.floors)
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                held = np.diff(part.column(2).offsets.to_numpy())
                terms, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                marks = length_mark(part.column(1).to_numpy(zero_copy_only=False), n_docs, total)
                rows = Rows(held, terms, document_value(tf, np.repeat(marks, held)), len(scale))
                search_trees(items, Node(_halves(rows, DOC_LEAF, scale), rows), ids, best)
        of = np.repeat(np.arange(n_items), [len(x) for x in best.scores])
        ids = np.concatenate(best.ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(of, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID),
             pa.array(np.concatenate(best.scores), pa.int64())], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(rows: list, docs: DataFrame, k: int) -> DataFrame | None:
    """One block of items, as (item_id, text) rows, against all documents."""
    spark = docs.sparkSession
    bags = [Counter(terms_of(r.text.encode() if r.text else None)) for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
    if not vocabulary:
        return None
    table = cut(_vectors(docs, vocabulary), "vectors")
    vectors = table.where("n > 0")
    n_docs, total = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = {r.pos: r.df for r in table.where("df is not null").select(F.posexplode("df").alias("pos", "df"))
          .groupBy("pos").agg(F.sum("df").alias("df")).collect()}  # a number for each term of the block
    matrix = np.zeros((len(rows), len(vocabulary)), np.int64)
    for i, bag in enumerate(bags):
        for t, times in bag.items():
            matrix[i, vocabulary[t]] = times * term_weight(n_docs, df[vocabulary[t]])
    items, scale = item_tree(matrix), matrix.max(axis=0).astype(np.float64)
    vectors = vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "counts")

    floors = np.zeros(len(rows), np.int64)
    if n_docs > 4 * SEED_DOCS:
        sample = vectors.sample(SEED_DOCS / n_docs, seed=1)
        seeds = _ranked(_matches(sample, items, scale, len(rows), floors, k, n_docs, total), k).where(F.col("rank") == k)
        for r in seeds.select("item", "score").collect():  # one row for each item
            floors[r.item] = r.score
    found = _matches(vectors, items, scale, len(rows), floors, k, n_docs, total)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item long, item_id long")
    return _ranked(found, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, from rank 1."""
    items = cut(items.select(F.col("item_id").cast("long"), "text",
                             F.monotonically_increasing_id().alias("number")), "items")
    blocks = max(1, math.ceil(items.count() / ITEMS))
    found = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).collect()  # about ITEMS rows
        one = _search_block(rows, docs, k) if rows else None
        found += [one] if one is not None else []
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents),
known AS (SELECT d, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
stats AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM known),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM known) GROUP BY d, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, stats),
marks AS (SELECT d, doc_id, 75 + (25 * n * n_docs) // total AS m FROM known, stats),
items AS (SELECT i, item_id, term, count(*) AS times
          FROM (SELECT i, item_id, unnest(terms) AS term
                FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark))
          GROUP BY i, item_id, term),
scores AS (SELECT i, item_id, d, doc_id,
                  sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN marks USING (d)
           GROUP BY i, item_id, d, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank,
                  doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

"""Connected components of a table of links, by alternating star joins.

Each round is two joins and two partial aggregates: "large star" links every
larger neighbour of a node to the smallest node around it, "small star" does
the same with the smaller neighbours and the node. The links shrink to stars
around the smallest node of each component in a logarithmic number of rounds.
A node that most links share is a hot key only of joins whose large side
adaptive execution can split; nothing is gathered by component.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

FOREST_LINKS = 1 << 20  # links folded at once before the first round


def _local_forest(batches):
    """Replace the links a task has read by a forest with the same components."""

    def flush(parent):
        pairs = [(x, _root(parent, x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)],
                                          names=["a", "b"])

    parent, n = {}, 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = _root(parent, a), _root(parent, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        n += batch.num_rows
        if n >= FOREST_LINKS:
            yield flush(parent)
            parent, n = {}, 0
    if parent:
        yield flush(parent)


def _root(parent: dict, x: int) -> int:
    top = x
    while (up := parent.setdefault(top, top)) != top:
        top = up
    while parent[x] != top:
        parent[x], x = top, parent[x]
    return top


def _star(links: DataFrame, around: DataFrame) -> DataFrame:
    """Link v to the smallest of u and its neighbours, for the (u, v) in ``links``."""
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u").where(F.col("v") != F.col("m")).select(
        F.col("v").alias("a"), F.col("m").alias("b"))


def _state(links: DataFrame):
    # decimal sums: 64-bit sums of hashes would overflow
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) links; root is the smallest node."""
    edges = cut(links.select(F.col("a").cast("long"), F.col("b").cast("long"))
                .mapInArrow(_local_forest, "a long, b long").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = cut(_star(both.where("v > u"), both).distinct(), "links")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        whole = down.unionByName(down.select("u", F.col("u").alias("v")))
        edges = cut(_star(whole, down).distinct(), "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return cut(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "components")

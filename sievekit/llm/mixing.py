"""Mixing sources to target weights with hash thresholds (DataFrame functions only).

Sources in code point order (NULL last) weigh 3, 1, 2, repeating, and share
``budget`` times all words; a target stops at ``max_repeat`` times its
source's words and the excess is shared again by weight. A document's copies
follow from one number per source: every document is taken ``full`` times,
and once more when the hash of its row lies below the source's threshold.

Thresholds come from histograms, never from a sort of documents: words are
summed per (source, 12 hash bits), the bucket in which the budget runs out is
found, and only that bucket is summed again by its next 12 bits, until it
holds one hash value. The document on the boundary is taken if that comes
nearer to the target.

Defined results: NULL or empty text has size 0 and is never taken; rows equal
in id and text share a hash and are taken alike; a NULL source is a source of
its own; extra columns, also of clashing names, pass through ``mix`` as they
are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEAT = 2
LEVEL_BITS, LEVELS = 12, 5  # 5 levels of 12 bits: a 60-bit hash


def row_hash(doc_id: Column, text: Column) -> Column:
    """First 60 bits of the md5 of id and text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"),
                            F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Join key that keeps NULL apart from text; orders like the source, NULL last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
            max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(key, source_size, target) from (key, source_size), one row per source.

    The weight of a source needs its rank; rows are ranked inside range
    partitions and shifted by the partitions before, so no task sorts all.
    """
    ranged = cut(sizes.repartitionByRange("key").withColumn("_part", F.spark_partition_id()), "mix-sources")
    ranked = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("key")))
    before = (ranged.groupBy("_part").count()
              .withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
              .select("_part", "_before"))
    rank = F.col("_before") + F.col("_n") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = cut(ranked.join(F.broadcast(before), "_part")
                .select("key", "source_size", weight.alias("_w"),
                        (F.col("source_size") * max_repeat).cast("double").alias("_cap")), "mix-weights")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # Water level: each round one aggregate; capped sources leave with their cap.
    level, open_ = 0.0, F.lit(True)
    while True:
        caps, w = table.agg(F.coalesce(F.sum(F.when(~open_, F.col("_cap"))), F.lit(0.0)),
                            F.coalesce(F.sum(F.when(open_, F.col("_w"))), F.lit(0.0))).first()
        if w == 0:
            break
        level = (budget * total - caps) / w
        now_open = F.col("_cap") > F.lit(level) * F.col("_w")
        if table.where(open_ & ~now_open).isEmpty():
            break
        open_ = now_open
    target = F.least(F.col("_cap"), F.lit(level) * F.col("_w")) if total else F.lit(0.0)
    return table.select("key", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame, n_sources: int) -> DataFrame:
    """(key, source_size, target, full, threshold) from (key, size, h) rows."""
    size = F.col("source_size")
    goal = wanted.withColumn("full", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
    goal = goal.withColumn("extra", F.col("target") - F.col("full") * size)
    # The bucket in which the budget runs out: its prefix, and the words before it.
    edge = goal.where(F.col("extra") > 0).select(
        "key", "extra", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        inside = rows.where(F.col("size") > 0).join(bounded_broadcast(edge, n_sources), "key").where(
            F.shiftrightunsigned("h", shift + LEVEL_BITS) == F.col("prefix"))
        hist = (inside.groupBy("key", F.shiftrightunsigned("h", shift).alias("b"))
                .agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"),
                     F.first("extra").alias("extra"), F.first("below").alias("base")))
        # At most 2^12 buckets of one source meet in a window.
        run = F.sum("words").over(Window.partitionBy("key").orderBy("b"))
        crossed = (hist.withColumn("below", F.col("base") + run - F.col("words"))
                   .where((F.col("below") <= F.col("extra")) & (F.col("extra") < F.col("below") + F.col("words"))))
        edge = cut(crossed.select("key", "extra", F.col("b").alias("prefix"), "below", "words", "low", "high"),
                   "mix-edge")
        if edge.where("low < high").isEmpty():
            break
    # What is left in an edge bucket shares one hash value: take it if nearer.
    nearer = (F.col("extra") - F.col("below")) * 2 > F.col("words")
    found = edge.select("key", F.when(nearer, F.col("high") + 1).otherwise(F.col("low")).alias("threshold"))
    return cut(goal.join(bounded_broadcast(found, n_sources), "key", "left")
               .select("key", "source_size", "target", "full",
                       F.coalesce("threshold", F.lit(0)).alias("threshold")), "mix-thresholds")


def plan(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, int]:
    """(narrow rows, thresholds per source, number of sources)."""
    narrow = cut(docs.select(
        F.col("doc_id"), source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"),
        row_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-rows")
    sizes = cut(narrow.groupBy("key").agg(F.sum("size").alias("source_size")), "mix-sizes")
    n_sources = sizes.count()
    return narrow, thresholds(narrow, targets(sizes, **options), n_sources), n_sources


def copies() -> Column:
    return F.col("full") + (F.col("h") < F.col("threshold")).cast("int")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    narrow, limits, n = plan(docs, **options)
    return narrow.join(bounded_broadcast(limits, n), "key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as it is taken."""
    _, limits, n = plan(docs, **options)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       source_key(F.col("source")).alias("key"),
                       word_count(F.col("text")).alias("size"),
                       row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    taken = held.join(bounded_broadcast(limits, n), "key").where(
        (F.col("size") > 0) & (copies() > 0))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies()))).select("_doc.*")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE n % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    2.0::DOUBLE * source_size AS cap FROM s),
r AS (
  SELECT *, coalesce(sum(cap) OVER lower_ones, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER lower_ones, 0) AS open_weight,
    1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM w WINDOW lower_ones AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (budget - caps) / open_weight AS level FROM r
      WHERE cap > (budget - caps) / open_weight * weight ORDER BY cap / weight, n LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l), 0) * weight) AS target FROM w),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_copies FROM t),
u AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
c AS (
  SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS below FROM u),
x AS (
  SELECT g.source, g.source_size, g.target, g.full_copies,
    max(CASE WHEN (g.target - g.full_copies * g.source_size - c.below) * 2 > c.words
             THEN c.h END) AS last_taken
  FROM g LEFT JOIN c ON g.source IS NOT DISTINCT FROM c.source
    AND c.below <= g.target - g.full_copies * g.source_size
  GROUP BY g.source, g.source_size, g.target, g.full_copies)
SELECT d.doc_id, d.size, x.source_size, x.target,
  CAST(d.size * (x.full_copies + CASE WHEN d.h <= coalesce(x.last_taken, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source"""

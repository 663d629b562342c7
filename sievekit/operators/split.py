"""Exact, reproducible stratified train/test split.

Per label, the rows whose seeded hash is among the ``ceil(n * test_size)``
smallest go to the test side. That is one comparison per row once the largest
hash of the test side is known, and it is found on narrow (label, hash) rows:
they are counted per hash bucket, and only the one bucket per label in which
the cut lies is ranked. Rows with equal keys share a hash and stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def seeded_hash(key: Column, seed: int) -> Column:
    """Hex md5 of ``key|seed`` (same value in Spark and in SQL engines)."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


#: Rows of the cut table (one per label) up to which it is broadcast.
BROADCAST_LABELS = 100_000


def cut_hashes(df: DataFrame, key: str, label: str, test_size: float, seed: int, bucket_hex: int = 4) -> DataFrame:
    """(label, largest hash of the test side); labels without test rows are absent."""
    narrow = df.select(label, seeded_hash(F.col(key), seed).alias("_h"))
    bucket = F.substring("_h", 1, bucket_hex)
    counts = narrow.groupBy(label, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    per_label = Window.partitionBy(label)  # at most 16^bucket_hex rows
    upto = per_label.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frac = F.lit(str(test_size)).cast("decimal(12,10)")
    edge = counts.select(
        label, "_b", "_n", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.ceil(F.sum("_n").over(per_label).cast("decimal(20,0)") * frac).cast("long").alias("_k"))
    edge = edge.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_n")))
    inside = narrow.withColumn("_b", bucket).join(_small(edge, "split-edge"), [label, "_b"])
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h"))
    return (inside.withColumn("_r", rank).where(F.col("_r") == F.col("_k") - F.col("_before"))
            .select(label, F.col("_h").alias("_cut")))


def _small(one_row_per_label: DataFrame, name: str) -> DataFrame:
    """Written once, then counted and broadcast if the labels are few: the
    input is not read again for the count."""
    rows = written(one_row_per_label, name)
    return F.broadcast(rows) if rows.count() <= BROADCAST_LABELS else rows


def stratified_split(df: DataFrame, key: str, label: str = "label", test_size: float = 0.2,
                     seed: int = 42, bucket_hex: int = 4) -> DataFrame:
    """``df`` plus a boolean ``is_test`` column."""
    cuts = _small(cut_hashes(df, key, label, test_size, seed, bucket_hex), "split-cuts")
    joined = df.join(cuts, label, "left")
    is_test = F.coalesce(seeded_hash(F.col(key), seed) <= F.col("_cut"), F.lit(False))
    return joined.select(*df.columns, is_test.alias("is_test"))

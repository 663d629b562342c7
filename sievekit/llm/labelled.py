"""Labelled rows for training, and the small numpy learners' shared parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, skip: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, text, label) of about ``max_rows`` labelled documents, by id hash.

    ``skip=(n, r)`` leaves out ids whose crc32 modulo n is r. Ids whose labels
    contradict each other, NULL ids and NULL labels are left out. The sample's
    ids are bounded by the parameter, so they are broadcast.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if skip:
        marks = marks.where(id_bucket(F.col("doc_id"), skip[0]) != skip[1])
    share = min(1.0, max_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1_000_000)) < int(share * 1_000_000))
    marks = (marks.groupBy(F.col("doc_id").cast("long").alias("label_id"))
             .agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
             .where("label = most").select("label_id", F.col("label").cast("int").alias("label")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(F.broadcast(marks), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def holdout(ids: np.ndarray, share: int = 5) -> np.ndarray:
    """Marks every ``share``-th id by a multiplicative hash: calibration rows."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)) % np.uint64(share) == 0

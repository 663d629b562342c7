import os
import sys

import pytest

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import CLASHING, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge rows, with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string").withColumn(
        "source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)))
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"own-{c}"))
    return df.repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

"""Texts of numbers, rounded by the exact binary value."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from sievekit.operators import triage as TR


def exact(x, digits):
    return f"{abs(Decimal(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)}"


@pytest.mark.parametrize("digits", [1, 2])
def test_fixed_on_ties_and_near_them(spark, digits):
    draw = random.Random(7)
    ties = [k / 8 for k in range(10_000)] + [k / 2 ** draw.randint(1, 40) for k in range(3000)]
    near = [draw.randint(0, 100_000) / 1000 for _ in range(10_000)] + [draw.random() * 100 for _ in range(5000)]
    tiny = [0.0, 5e-324, 1e-300, 2.0 ** -26, 2.0 ** -27, 0.005, 0.05, 0.045, 1.005, 99.995, 99.95, 100.0, 1e9 + 0.25, 2.0 ** 52 + 1]
    xs = ties + near + tiny
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", TR.fixed(F.col("x"), digits).alias("t")).collect()
    assert [r.t for r in got] == [exact(r.x, digits) for r in got]


def test_sign_and_missing(spark):
    df = spark.createDataFrame([(-0.125,), (-12.345,), (None,), (float("nan"),), (0.125,)], "x double")
    got = [r.t for r in df.select(TR.percent_text(F.col("x")).alias("t")).collect()]
    assert got == ["-12.50%", "-1234.50%", "N/A", "N/A", "12.50%"]


def test_ties_go_up(spark):
    df = spark.createDataFrame([(0.25,), (0.75,), (12.25,), (0.125,)], "x double")
    assert [r.t for r in df.select(TR.fixed(F.col("x"), 1).alias("t")).collect()] == ["0.3", "0.8", "12.3", "0.1"]
    assert [r.t for r in df.select(TR.fixed(F.col("x"), 2).alias("t")).collect()] == ["0.25", "0.75", "12.25", "0.13"]

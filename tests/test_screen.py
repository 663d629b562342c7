"""Screening: one verdict per row, reduced inside the row."""

import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators import urls
from sievekit.operators.score import RuleScorer, screen

ATTACK = "x' OR 1=1 --"


def test_every_row_has_its_own_verdict(spark):
    rows = [(1, "http://h/p?a=1"), (1, f"http://h/p?q={ATTACK}"), (1, "SELECT 1"), (None, ATTACK), (None, "plain"),
            (2, None), (3, "")]
    got = screen(spark.createDataFrame(rows, "request_id INT, query STRING")).collect()
    assert len(got) == 7
    by_text = {r.query: r for r in got}
    assert by_text["http://h/p?a=1"].is_sql_injection is False and by_text["http://h/p?a=1"].params_scored == 0
    assert by_text[rows[1][1]].is_sql_injection and by_text[rows[1][1]].vulnerable_parameter == "q"
    assert by_text[ATTACK].is_sql_injection and not by_text["plain"].is_sql_injection
    assert {r.error for r in got if r.query in (None, "")} == {"Invalid query input"}


def test_rule_path_has_no_exchange(spark):
    df = spark.range(100).select(F.col("id").alias("request_id"), F.concat(F.lit("http://h/?a="), "id").alias("query"))
    plan = screen(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def brute(items):
    """Names in order of first appearance, values in order, strictly higher wins."""
    names = list(dict.fromkeys(n for _, n, _, _ in items))
    best = (0.0, None, None)
    for name in names:
        for _, n, value, p in items:
            if n == name and p > best[0]:
                best = (p, n, value)
    return best


def test_worst_item_against_a_loop(spark):
    draw = random.Random(7)
    cases = [[(i, draw.choice("abc"), f"v{i}", draw.choice([0.0, 0.25, 0.5, 0.5, 0.75])) for i in range(draw.randint(0, 7))]
             for _ in range(300)]
    kind = "items array<struct<pos:int,name:string,value:string,prob:double>>"
    df = spark.createDataFrame([(c,) for c in cases], kind).select(urls.worst_item(F.col("items")).alias("w"))
    assert [tuple(r.w) for r in df.collect()] == [brute(c) for c in cases]


def test_many_parameters_take_linear_time(spark):
    url = "http://h/?" + "&".join(f"p{i % 50}=a b{i}" for i in range(20_000)) + "&z=" + ATTACK
    r = screen(spark.createDataFrame([(1, url)], "request_id INT, query STRING"), carry=["request_id"]).first()
    assert r.is_sql_injection and r.vulnerable_parameter == "z" and r.params_scored == 20_001


def test_strict_url(spark):
    df = spark.createDataFrame([(1, "is 1=1 ok?"), (2, "http://h/?a=b c")], "request_id INT, query STRING")
    assert [r.route for r in screen(df).orderBy("request_id").collect()] == ["url", "url"]
    assert [r.route for r in screen(df, strict_url=True).orderBy("request_id").collect()] == ["raw", "url"]


def test_clashing_columns_are_carried(spark):
    df = spark.createDataFrame([(1, ATTACK, "own", 5)], "request_id INT, query STRING, _items STRING, prob INT")
    r = screen(df, carry=["request_id", "query", "_items", "prob"]).first()
    assert (r._items, r.prob) == ("own", 5) and r.is_sql_injection


@pytest.mark.parametrize("text,score", [("plain", 0.0), (ATTACK, 0.5)])
def test_rule_score(spark, text, score):
    p = spark.createDataFrame([(text,)], "t STRING").select(RuleScorer().column(F.col("t"))).first()[0]
    assert (p > score) == (score > 0)

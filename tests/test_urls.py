"""URL routing and query-string parsing against urllib.parse."""

from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from sievekit.operators import urls
from sievekit.operators.score import RuleScorer, screen

URLS = [
    "http://a.b/c?x=%zz&y=a+b&y=&z=%E9&y=2#frag",
    "a?x==1&=v&noeq&k=%26%3D",
    "http://example.com/page?id=1' OR '1'='1",
    "https://google.com/search?q=test",
    "https://h/p?b=1;c=2&a=%41%42",
    "https://h/p#frag?x=1",
    "https://h/p?x=1?y=2",
    "  https://h/p?x=%2B+1",
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "id INT, query STRING")
    rows = df.select("id", urls.url_params(F.col("query")).alias("p")).collect()
    return {r["id"]: r["p"] for r in rows}


@pytest.mark.parametrize("i", range(len(URLS)))
def test_params_match_parse_qs(parsed, i):
    want = parse_qs(urlparse(URLS[i]).query)
    got = {}
    for p in sorted(parsed[i], key=lambda p: p["pos"]):
        got.setdefault(p["name"], []).append(p["value"])
    assert got == want
    assert list(got) == list(want)  # first-appearance order of names


def test_route(spark):
    rows = [(1, None), (2, ""), (3, "?"), (4, "SELECT * FROM t WHERE a=?"), (5, "http://x.y/z"),
            (6, "SELECT 1"), (7, "ftp+x://host"), (8, "1http://host")]
    df = spark.createDataFrame(rows, "id INT, query STRING")
    got = {r["id"]: r["r"] for r in df.select("id", urls.route(F.col("query")).alias("r")).collect()}
    assert got == {1: "invalid", 2: "invalid", 3: "url", 4: "url", 5: "url", 6: "raw",
                   7: "url", 8: "raw"}


def test_worst_parameter_tie_order(spark):
    # all three values score the same; names are visited in first-appearance
    # order (a, a, b), so the first 'a' value wins
    rows = [(1, "http://h/p?a=1'&b=2'&a=3'"), (2, "http://h/p?b=x'&a=9'&b=y'"),
            (3, "http://h/p?a=1&b=2"), (4, "http://h/p"), (5, "http://h/p?q=1' OR '1'='1")]
    df = spark.createDataFrame(rows, "request_id INT, query STRING")
    v = {r["request_id"]: r for r in screen(df, scorer=RuleScorer()).collect()}
    assert (v[1]["vulnerable_parameter"], v[1]["suspicious_value"]) == ("a", "1'")
    assert (v[2]["vulnerable_parameter"], v[2]["suspicious_value"]) == ("b", "x'")
    # all values alphanumeric: nothing scored, probability 0, confidence 1
    assert v[3]["probability_injection"] == 0.0 and v[3]["confidence"] == 1.0
    assert v[3]["vulnerable_parameter"] is None and v[3]["params_scored"] == 0
    # no parameters at all: the fixed safe answer
    assert v[4]["confidence"] == 0.99 and v[4]["note"] == "No parameters found in URL"
    assert v[5]["is_sql_injection"] and v[5]["vulnerable_parameter"] == "q"


def test_verdict_independent_of_partitioning(spark):
    from sievekit.sources import tables as T
    base = T.requests(spark, "/root/testdata/sf0.001")
    a = screen(base.coalesce(1), scorer=RuleScorer(), carry=["request_id"])
    b = screen(base.repartition(13, "user_id"), scorer=RuleScorer(), carry=["request_id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))

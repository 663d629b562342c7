import re

import pytest

from sievekit.llm import url_filter as uf

URLS = [
    ("http://a.net/x", "net/", "block"), ("http://net/", "net/", "block"), ("http://a.net", None, "allow"),
    ("http://Example.NET/en/1", "example.net/en/", "allow"), ("http://www.example.net/en/1?q", "example.net/en/", "allow"),
    ("http://www.example.net/EN/1", "net/", "block"), ("http://notexample.net/en/", "net/", "block"),
    ("http://example.com/de/", "example.com/de/", "block"), ("http://example.com/de", None, "allow"),
    ("http://a.org/fr/porn", "org/fr/", "allow"), ("http://a.org/en/porn", None, "block"),
    ("http://a.org/popcorn-pornography", None, "allow"), ("http://a.org/casino-poker", None, "block"),
    ("http://a.org/casino/casino", None, "allow"), ("http://sex.a.org/?x=xxx#a", None, "block"),
    ("no scheme porn", None, "block"), ("no scheme", None, "allow"), (None, None, "allow"), ("", None, "allow"),
    ("://", None, "allow"), ("x://h?y://net/", None, "allow"), ("http://h" + "a" * 100_000 + "/xxx", None, "block"),
]


def test_rules_then_vocabulary(spark):
    rows = [(i, u, "own", "own") for i, (u, _, _) in enumerate(URLS)] + [(None, URLS[0][0], "own", "own")]
    got = uf.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string")).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: (r.rule, r.verdict) for r in got}
    for i, (url, rule, verdict) in enumerate(URLS):
        assert by_id[i] == (rule, verdict), url
    assert by_id[None] == ("net/", "block")


def test_host_and_path():
    assert uf.split_url("HTTP://User@WWW.A.com:80/P/Q?x#y") == ("user@www.a.com:80", "/P/Q")
    assert uf.split_url("http://a.com?x/y") == ("a.com", "")
    assert uf.split_url(None) == uf.split_url("a.com/x") == ("", "")


def test_hits_match_a_regex(spark):
    vocabulary = uf.Vocabulary(uf.TERMS, uf.REJECT_AT)
    for text in ["porn", "xporn", "porn.porn adult_sex", "ADULT-sex/pills1", "keygen\ncrack", "ésexé"]:
        found = {t for t, _ in uf.TERMS if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text.lower())}
        strict = sum(w >= uf.REJECT_AT for t, w in uf.TERMS if t in found)
        assert vocabulary.hits(text)[:2] == (strict, len(found) - strict)


def test_empty_table(spark):
    assert uf.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("url", ["http://b.a.net/", "http://a.net/x/y"])
def test_longest_rule_wins(url):
    rules = uf.Rules([("allow", "net/"), ("block", "a.net/"), ("allow", "a.net/x/y"), ("block", "a.net/x/")])
    host, path = uf.split_url(url)
    assert rules.match(host, path) == (("a.net/", "block") if "b." in url else ("a.net/x/y", "allow"))

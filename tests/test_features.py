"""The 144 Spark features against Python ``str``/``re`` semantics.

The expected values come from a small interpreter of the feature spec rows
that uses Python's own string methods and regex engine on the original
(un-rewritten) patterns, so Unicode classes, case folding, non-overlapping
counts and the depth fold are all checked against the language the rules
were written for.
"""

import re

import pytest

from sievekit.functions.features import FEATURES, featurize
from sievekit.functions.patterns import ATTACK_PATTERNS
from sievekit.sources.templates import ATTACK_TEMPLATES, SAFE_TEMPLATES

EDGE = [
    "", "'" * 1000, "))((a)(", "-----", "a;b;", "'é'='é'", "²=²", "ſleep(1)", "?",
    "SELECT * FROM t WHERE a=?", "http://a.b/c?x=%zz&y=a+b&y=&z=%E9&y=2#frag",
    "a?x==1&=v&noeq&k=%26%3D", "Straße OR 1=1", "ſelect KEY İNFORMATION_SCHEMA ınto",
    "a\u00a0OR\u00a01=1", "x\x1cAND\x1d2=2", "\u0663=\u0663", "CHAR(39)\nOR\tsleep (3)",
    "abc\n", "$where: $ne $gt $lt $regex 0x1F sys.tables @@version", "((((((a))))))",
    "IF(1=1,SLEEP(5),0) CASE WHEN IIF( ; DROP", "<a> FLOOR(RAND(0)*2) LOAD_FILE INTO OUTFILE",
]
ROWS = EDGE + SAFE_TEMPLATES + ATTACK_TEMPLATES


def expected(f, q):
    src = {"q": q, "qu": q.upper(), "ql": q.lower()}[f.source]
    k = f.kind
    if k == "length":
        return len(q)
    if k == "words":
        return len(q.split())
    if k == "parts":
        return len(q.split(f.arg))
    if k == "count":
        return src.count(f.arg)
    if k == "patterns":
        return sum(1 for p in ATTACK_PATTERNS if re.search(p, q, re.IGNORECASE))
    if k == "ratio":
        return src.count(f.arg) / len(src) if len(src) else 0.0
    if k == "has":
        return int(any(x in src for x in f.arg))
    if k == "has_all":
        return int(all(x in src for x in f.arg))
    if k == "search":
        return int(re.search(f.arg, src) is not None)
    if k == "findall":
        return len(re.findall(f.arg, src))
    if k == "multi":
        return int(";" in q and len(q.split(";")) > 2)
    if k == "depth":
        bal = best = 0
        for ch in q:
            if ch == "(":
                bal += 1
                best = max(best, bal)
            elif ch == ")":
                bal -= 1
        return best
    raise ValueError(k)


@pytest.fixture(scope="module")
def computed(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(ROWS)], "id INT, query STRING")
    return {r["id"]: r for r in featurize(df, keep=["id"]).collect()}


def test_feature_names_and_order():
    assert len(FEATURES) == 144
    assert FEATURES[0].name == "query_length" and FEATURES[72].name == "pattern_match_count"
    assert FEATURES[135].name == "max_nested_depth" and FEATURES[143].name == "has_replace"


@pytest.mark.parametrize("f", FEATURES, ids=[f.name for f in FEATURES])
def test_feature_matches_python(computed, f):
    bad = []
    for i, q in enumerate(ROWS):
        got, want = computed[i][f.name], expected(f, q)
        if isinstance(want, float):
            ok = abs(got - want) < 1e-12
        else:
            ok = got == want
        if not ok:
            bad.append((q[:40], got, want))
    assert not bad, bad[:5]


def test_null_text_gives_null_features(spark):
    df = spark.createDataFrame([(1, None)], "id INT, query STRING")
    row = featurize(df, keep=["id"]).first()
    assert row["query_length"] is None and row["pattern_match_count"] is None


def test_rules_run_only_where_their_literals_are():
    """Each literal a pattern cannot match without, and none that it can."""
    from sievekit.functions.patterns import ATTACK_PATTERNS, plain_alternatives
    from sievekit.functions.rx import mandatory
    assert mandatory(r"UNION\s+(ALL\s+)?SELECT") == [["UNION"], ["SELECT"]]
    assert mandatory(r"(OR|AND)\s+\d+\s*=\s*\d+") == [["="], ["OR", "AND"]]
    assert mandatory(r"%[0-9a-fA-F]{2}") == [["%"]] and mandatory(r"ab?c+d") == [["a"], ["c"], ["d"]]
    assert mandatory(r"a|b") == [] and mandatory(r"\s+") == []
    assert set(plain_alternatives(ATTACK_PATTERNS[0])) == {"'", ";", "--", "/*", "*/", *"+%=()[]{}"}
    assert [p for p in ATTACK_PATTERNS[1:] if not mandatory(p)] == []

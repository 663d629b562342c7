"""Linear forms of patterns: same answers as the originals, no blow-up."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sievekit.functions import rx
from sievekit.functions.features import FEATURES, featurize
from sievekit.functions.patterns import ATTACK_PATTERNS, pattern_count

PIECES = ["IF", "if", "CHAR", "FLOOR", "RAND", "SLEEP", "AND", "OR", "UNION", "(", ")", "(", ")", " ", "  ", "\t", "\n",
          "=", "1", "23", "a", "b_", "'", " ", "²", "é", "x"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    made = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 25))) for _ in range(4000)]
    return made + ["IF(IF()SLEEP", "IF(aIF()SLEEP", "IF(IF(a)SLEEP", "CHAR(CHAR()", "FLOOR(FLOOR(RAND(", "FLOOR()RAND(",
                   " AND AND ", "a  AND  AND b", " OR OR OR ", "1 = = 2", "1=2", "١=٢"]


@pytest.mark.parametrize("pattern", sorted(rx._LINEAR))
def test_same_answer_as_the_original(spark, texts, pattern):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    fast = rx.portable(rx.linear(pattern))
    counted = any(f.kind == "findall" and f.arg == pattern for f in FEATURES)
    got = dict(df.select("i", F.regexp_count("t", F.lit(fast)) if counted else F.col("t").rlike(fast).cast("int")).collect())
    for i, t in enumerate(texts):
        want = len(re.findall(pattern, t)) if counted else int(re.search(pattern, t) is not None)
        assert got[i] == want, (pattern, t)


def test_case_insensitive_rule(spark, texts):
    rules = [p for p in ATTACK_PATTERNS if p in rx._LINEAR]
    assert rules
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = dict(df.select("i", pattern_count(F.col("t"), rules)).collect())
    for i, t in enumerate(texts):
        assert got[i] == sum(re.search(p, t, re.I) is not None for p in rules), t


HOSTILE = {
    "letters": "a" * 100_000, "digits": "1" * 100_000, "spaces": " " * 100_000, "quotes": "'" * 100_000,
    "if": "IF(" * 33_000, "char": "CHAR(" * 20_000, "floor": "FLOOR(" * 16_000, "sleep": "IF(a" * 25_000 + ")",
    "or": "' OR 1" * 16_000, "and": "AND " * 25_000, "equals": "1 " * 50_000, "semicolons": ";" * 100_000,
    "words": "a " * 50_000, "mixed": ("IF( CHAR( FLOOR(RAND " * 5_000), "parens": "(" * 100_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_text_takes_seconds(spark, name):
    df = spark.createDataFrame([(HOSTILE[name],)], "query STRING")
    featurize(df.where("query = ''"), keep=[]).collect()  # compile first
    start = time.time()
    featurize(df, keep=[]).collect()
    assert time.time() - start < 10


# Written out by hand, not from the feature table.
EXPECTED = {
    "": {"query_length": 0, "word_count": 0, "semicolon_count": 1, "single_quote_ratio": 0.0, "pattern_match_count": 0},
    "admin' OR '1'='1": {
        "query_length": 16, "word_count": 3, "single_quote_count": 4, "equals_count": 1, "keyword_or": None,
        "keyword_select": 0, "single_quote_ratio": 4 / 16, "has_or_1_equals_1": 0, "has_string_equals": 0,
        "has_boolean_equals": 0, "or_count": 1, "and_count": 0, "max_nested_depth": 0, "has_advanced_boolean": 1},
    "'; DROP TABLE users; --": {
        "semicolon_count": 3, "semicolon_char_count": 2, "double_dash_count": 1, "double_dash_freq": 1,
        "keyword_drop": 1, "keyword_table": 1, "has_drop": 1, "has_multiple_statements": 1,
        "semicolon_statements": 1, "has_second_order_semicolon": 1, "has_double_dash": 1},
    "SELECT IF(1=1, SLEEP(5), CHAR(65)) UNION ALL SELECT ((2))": {
        "keyword_select": 2, "keyword_if": 1, "keyword_sleep": 1, "keyword_char": 1, "keyword_union": 1,
        "function_call_count": 4, "has_sleep": 1, "has_union": 1, "union_count": 1, "open_paren_count": 5,
        "close_paren_count": 5, "max_nested_depth": 2, "has_if_statement": 0, "has_char_func_call": 1,
        "has_boolean_equals": 1, "has_char_func": 1},
}


@pytest.mark.parametrize("text", sorted(EXPECTED))
def test_values_written_by_hand(spark, text):
    row = featurize(spark.createDataFrame([(text,)], "query STRING"), keep=[]).first().asDict()
    for name, value in EXPECTED[text].items():
        if value is None:
            assert name not in row
        else:
            assert row[name] == pytest.approx(value), name

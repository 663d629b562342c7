"""The 144 lexical features, as plain Spark column expressions.

Every feature is a row of ``FEATURES``: a name, a kind and its arguments.  The
kind says how to evaluate it; ``feature_column`` turns a row into a Column and
the test oracle renders the same rows as SQL, so names, order and meaning can
not drift apart.  Features read one of three forms of the text: the raw text
``q``, its upper-case form ``qu`` and its lower-case form ``ql``.

No UDF is involved: every feature is a JVM expression, so a ``select`` of a
subset only computes that subset (column pruning) and the whole projection
runs inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import gated, pattern_count
from .rx import NON_SPACE, linear, mandatory, portable

# ---------------------------------------------------------------------------
# Punctuation counted in the raw text (feature name, sequence),
# the 50 keywords counted in the upper-case text, and the feature rows 72-143
# with their literals and regular expressions (Python regex syntax), all in
# their original order.
# ---------------------------------------------------------------------------
PUNCTUATION = [
    ("single_quote_count", "'"), ("double_quote_count", '"'), ("semicolon_char_count", ";"),
    ("double_dash_count", "--"), ("comment_start_count", "/*"), ("comment_end_count", "*/"),
    ("equals_count", "="), ("open_paren_count", "("), ("close_paren_count", ")"),
    ("open_bracket_count", "["), ("close_bracket_count", "]"), ("open_brace_count", "{"),
    ("close_brace_count", "}"), ("plus_count", "+"), ("percent_count", "%"),
    ("asterisk_count", "*"), ("pipe_count", "|"), ("ampersand_count", "&"), ("caret_count", "^"),
]

SQL_KEYWORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER",
    "EXEC", "EXECUTE", "UNION", "SCRIPT", "TABLE", "DATABASE", "SCHEMA",
    "TRUNCATE", "GRANT", "REVOKE", "SHUTDOWN", "SHOW", "DESCRIBE", "DESC",
    "INFORMATION_SCHEMA", "SYS", "SYSTEM", "DUAL", "CONCAT", "SUBSTRING",
    "MID", "LENGTH", "CHAR", "ASCII", "ORD", "HEX", "UNHEX", "BENCHMARK",
    "SLEEP", "WAITFOR", "DELAY", "IF", "CASE", "WHEN", "THEN", "ELSE",
    "HAVING", "GROUP BY", "ORDER BY", "LIMIT", "OFFSET", "TOP", "ROWNUM",
]

# kind: ratio (literal / length), has (any literal present), has_all (every
# literal present), search (regex found), findall (regex match count),
# count (literal count), depth, multi (more than one statement separator)
TAIL_FEATURES = [
    ("pattern_match_count", "patterns", "q", None),
    ("single_quote_ratio", "ratio", "q", "'"),
    ("equals_ratio", "ratio", "q", "="),
    ("paren_ratio", "ratio", "q", "("),
    ("has_double_dash", "has", "q", ("--",)),
    ("has_comment_start", "has", "q", ("/*",)),
    ("has_comment_end", "has", "q", ("*/",)),
    ("has_semicolon", "has", "q", (";",)),
    ("has_or_1_equals_1", "has", "qu", ("OR 1=1", "OR'1'='1'")),
    ("has_union", "has", "qu", ("UNION",)),
    ("has_exec", "has", "qu", ("EXEC",)),
    ("has_drop", "has", "qu", ("DROP",)),
    ("has_delete", "has", "qu", ("DELETE",)),
    ("has_insert", "has", "qu", ("INSERT",)),
    ("has_update", "has", "qu", ("UPDATE",)),
    ("has_percent", "has", "q", ("%",)),
    ("has_hex", "has", "ql", ("0x",)),
    ("has_char_func", "has", "qu", ("CHAR(",)),
    ("has_ascii_func", "has", "qu", ("ASCII(",)),
    ("double_dash_freq", "count", "q", "--"),
    ("comment_start_freq", "count", "q", "/*"),
    ("comment_end_freq", "count", "q", "*/"),
    ("has_boolean_equals", "search", "q", r"\d+\s*=\s*\d+"),
    ("has_string_equals", "search", "q", r"'\w+'\s*=\s*'\w+'"),
    ("function_call_count", "findall", "q", r"\w+\s*\("),
    ("has_sleep", "search", "qu", r"SLEEP\s*\("),
    ("has_waitfor", "search", "qu", r"WAITFOR\s+DELAY"),
    ("has_benchmark", "search", "qu", r"BENCHMARK\s*\("),
    ("has_pg_sleep", "search", "qu", r"PG_SLEEP\s*\("),
    ("has_if_statement", "search", "qu", r"IF\s*\([^)]+\)\s*\w+"),
    ("has_case_when", "search", "qu", r"CASE\s+WHEN"),
    ("has_iif", "search", "qu", r"IIF\s*\("),
    ("semicolon_statements", "findall", "q", r";\s*\w+"),
    ("has_multiple_statements", "multi", "q", None),
    ("has_information_schema", "has", "qu", ("INFORMATION_SCHEMA",)),
    ("has_sys_table", "search", "ql", r"sys\.\w+"),
    ("has_system_var", "search", "q", r"@@\w+"),
    ("url_encoded_count", "findall", "q", r"%[0-9a-fA-F]{2}"),
    ("hex_encoded_count", "findall", "ql", r"0x[0-9a-fA-F]+"),
    ("has_char_func_call", "search", "qu", r"CHAR\s*\([^)]+\)"),
    ("has_concat", "search", "qu", r"CONCAT\s*\("),
    ("has_hex_func", "search", "qu", r"HEX\s*\("),
    ("has_unhex", "search", "qu", r"UNHEX\s*\("),
    ("has_from_base64", "search", "qu", r"FROM_BASE64\s*\("),
    ("has_to_base64", "search", "qu", r"TO_BASE64\s*\("),
    ("has_extractvalue", "has", "qu", ("EXTRACTVALUE",)),
    ("has_updatexml", "has", "qu", ("UPDATEXML",)),
    ("has_xml_tags", "has_all", "q", ("<", ">")),
    ("has_second_order_semicolon", "search", "q", r"'\s*;\s*\w+"),
    ("has_second_order_union", "search", "qu", r"'\s*UNION\s+"),
    ("has_nosql_where", "has", "ql", ("$where",)),
    ("has_nosql_ne", "has", "ql", ("$ne",)),
    ("has_nosql_gt", "has", "ql", ("$gt",)),
    ("has_nosql_lt", "has", "ql", ("$lt",)),
    ("has_nosql_regex", "has", "ql", ("$regex",)),
    ("has_advanced_boolean", "search", "qu", r"'\s*(OR|AND)\s+['\"]?\d+['\"]?\s*=\s*['\"]?\d+"),
    ("has_like_injection", "search", "qu", r"'\s*(OR|AND)\s+['\"]?\w+['\"]?\s*LIKE\s+"),
    ("has_extractvalue_error", "search", "qu", r"EXTRACTVALUE\s*\("),
    ("has_updatexml_error", "search", "qu", r"UPDATEXML\s*\("),
    ("has_floor_rand", "search", "qu", r"FLOOR\s*\([^)]*RAND\s*\("),
    ("has_load_file", "has", "qu", ("LOAD_FILE",)),
    ("has_into_outfile", "has", "qu", ("INTO OUTFILE",)),
    ("has_into_dumpfile", "has", "qu", ("INTO DUMPFILE",)),
    ("max_nested_depth", "depth", "q", None),
    ("and_count", "findall", "qu", r"\s+AND\s+"),
    ("or_count", "findall", "qu", r"\s+OR\s+"),
    ("union_count", "findall", "qu", r"\s+UNION\s+"),
    ("has_substring", "has", "qu", ("SUBSTRING", "SUBSTR")),
    ("has_mid", "has", "qu", ("MID",)),
    ("has_left", "has", "qu", ("LEFT",)),
    ("has_right", "has", "qu", ("RIGHT",)),
    ("has_replace", "has", "qu", ("REPLACE",)),
]


@dataclass(frozen=True)
class Feature:
    index: int
    name: str
    kind: str
    source: str  # "q", "qu" or "ql"
    arg: object

    @property
    def is_ratio(self) -> bool:
        return self.kind == "ratio"


def _build_specs() -> list[Feature]:
    rows = [
        ("query_length", "length", "q", None),
        ("word_count", "words", "q", None),
        ("semicolon_count", "parts", "q", ";"),
    ]
    rows += [(name, "count", "q", seq) for name, seq in PUNCTUATION]
    rows += [("keyword_" + kw.lower().replace(" ", "_"), "count", "qu", kw) for kw in SQL_KEYWORDS]
    rows += TAIL_FEATURES
    return [Feature(i, *row) for i, row in enumerate(rows)]


FEATURES: list[Feature] = _build_specs()
FEATURE_NAMES: list[str] = [f.name for f in FEATURES]
assert len(FEATURES) == 144, len(FEATURES)


def feature_group(lo: int, hi: int) -> list[Feature]:
    """Features with ``lo <= index <= hi``."""
    return [f for f in FEATURES if lo <= f.index <= hi]


# --- expression builders --------------------------------------------------

def literal_count(text: Column, seq: str) -> Column:
    """Non-overlapping occurrences of ``seq`` (Python ``str.count``).

    Every removed occurrence takes exactly ``bytes(seq)`` UTF-8 bytes with it,
    so byte lengths (O(1) in Spark) give the count without scanning the text
    twice more for its character length; ``replace`` with no match returns
    the text itself without copying. Its search is several times slower than
    that of ``contains``, so only texts that hold the literal take it.
    """
    width = len(seq.encode("utf-8"))
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(seq), F.lit("")))
    n = removed.cast("long") if width == 1 else F.floor(removed / F.lit(width)).cast("long")
    return gated(text, text, [[seq]], n, F.lit(0).cast("long"))


def nesting_depth(text: Column) -> Column:
    """Highest running balance of '(' over ')' (a negative balance is kept)."""
    steps = F.split(F.regexp_replace(text, r"[^()]", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc, ch):
        up = acc["d"] + 1
        return (F.when(ch == "(", F.struct(up.alias("d"), F.greatest(acc["m"], up).alias("m")))
                 .when(ch == ")", F.struct((acc["d"] - 1).alias("d"), acc["m"].alias("m")))
                 .otherwise(acc))

    depth = F.aggregate(steps, start, step, lambda acc: acc["m"]).cast("long")
    return gated(text, text, [["("]], depth, F.lit(0).cast("long"))


def feature_column(f: Feature, q: Column, qu: Column, ql: Column) -> Column:
    src = {"q": q, "qu": qu, "ql": ql}[f.source]
    k = f.kind
    if k == "length":
        col = F.length(src).cast("long")
    elif k == "words":
        col = F.regexp_count(src, F.lit(NON_SPACE + "+")).cast("long")
    elif k == "parts":
        col = literal_count(src, f.arg) + 1
    elif k == "count":
        col = literal_count(src, f.arg)
    elif k == "patterns":
        col = pattern_count(src)
    elif k == "ratio":
        n = F.length(src)
        col = F.when(n > 0, literal_count(src, f.arg) / n).otherwise(F.lit(0.0))
    elif k in ("has", "has_all"):
        # A literal that is also counted needs no pass of its own: the count
        # asks the same first.
        tests = [src.contains(lit) for lit in f.arg]
        col = tests[0]
        for t in tests[1:]:
            col = (col | t) if k == "has" else (col & t)
        col = col.cast("long")
    elif k == "search":
        col = gated(src, src, mandatory(f.arg), src.rlike(portable(linear(f.arg))).cast("long"), F.lit(0).cast("long"))
    elif k == "findall":
        n = F.regexp_count(src, F.lit(portable(linear(f.arg)))).cast("long")
        col = gated(src, src, mandatory(f.arg), n, F.lit(0).cast("long"))
    elif k == "multi":
        col = (src.contains(";") & (literal_count(src, ";") + 1 > 2)).cast("long")
    elif k == "depth":
        col = nesting_depth(src)
    else:  # pragma: no cover - spec table is fixed
        raise ValueError(k)
    return col.alias(f.name)


def with_text_forms(df: DataFrame, col: str = "query") -> DataFrame:
    """Add the upper/lower forms once, so 144 features share them."""
    return df.withColumns({"_qu": F.upper(F.col(col)), "_ql": F.lower(F.col(col))})


def featurize(df: DataFrame, col: str = "query", features: list[Feature] | None = None,
              keep: list[str] | None = None) -> DataFrame:
    """Append one column per feature to ``df`` (all 144 by default).

    ``keep`` lists the input columns to carry along (default: all of them).
    """
    specs = FEATURES if features is None else features
    carry = list(df.columns) if keep is None else list(keep)
    forms = with_text_forms(df, col)
    q, qu, ql = F.col(col), F.col("_qu"), F.col("_ql")
    return forms.select(*[F.col(c) for c in carry],
                        *[feature_column(f, q, qu, ql) for f in specs])


def assemble(df: DataFrame, names: list[str] | None = None, output: str = "features") -> DataFrame:
    """Feature columns → one ``ml.linalg`` vector column."""
    cols = FEATURE_NAMES if names is None else names
    return VectorAssembler(inputCols=cols, outputCol=output, handleInvalid="keep").transform(df)

"""Labelled corpora: reading a labelled file, and augmenting from templates.

``read_labelled`` resolves the text and label columns by name (the first
name of each list that the file has, exact case), normalises label
spellings to 0/1 and sets rows with an unknown label aside. ``augment`` turns
given texts into a labelled corpus: a text stays as it is, varied, or gets an
attack template, with all choices taken from a seeded hash of its key, so the
result does not depend on partitioning or on re-execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .templates import ATTACK_TEMPLATES

# ---------------------------------------------------------------------------
# Accepted column names (in priority order) and label spellings.
# ---------------------------------------------------------------------------
QUERY_NAMES = ["query", "Query", "sql", "SQL", "payload", "Payload", "text", "Text", "input", "Input"]
LABEL_NAMES = ["label", "Label", "is_sql_injection", "is_sqli", "target", "Target", "class", "Class"]
SAFE_SPELLINGS = ["0", "safe", "normal", "False", "false"]
ATTACK_SPELLINGS = ["1", "unsafe", "sql_injection", "True", "true"]

SAFE_VARIED = 0.5         # safe samples whose '1' is replaced by a number 1..99
ATTACK_PREFIXED = 0.3     # attack samples that begin with the given text


def resolve_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """First matching text and label column names (schema only, no data)."""
    q = next((c for c in QUERY_NAMES if c in columns), None)
    lab = next((c for c in LABEL_NAMES if c in columns), None)
    return q, lab


def normalise_label(raw: Column) -> Column:
    s = raw.cast("string")
    return (F.when(s.isin(*SAFE_SPELLINGS), F.lit(0))
             .when(s.isin(*ATTACK_SPELLINGS), F.lit(1)))


def labelled(df: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(corpus(query, label), rejects(query, raw_label)) or None when the
    columns cannot be resolved."""
    qc, lc = resolve_columns(df.columns)
    if qc is None or lc is None:
        return None
    base = df.select(F.col(qc).cast("string").alias("query"), F.col(lc).alias("raw_label"))
    norm = base.withColumn("label", normalise_label(F.col("raw_label")))
    good = norm.where(F.col("label").isNotNull()).select("query", "label")
    bad = norm.where(F.col("label").isNull()).select("query", F.col("raw_label").cast("string"))
    return good, bad


def read_labelled(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False):
    """Read a labelled file; every column is read as text for CSV.

    ``multi_line`` allows line breaks inside quoted values; such a CSV file
    cannot be split and is one task, so large inputs should leave it off or be
    parquet.
    """
    reader = spark.read
    if fmt == "csv":
        reader = (reader.option("header", True).option("multiLine", multi_line)
                  .option("escape", '"').option("inferSchema", False))
    return labelled(reader.format(fmt).load(path))


# --- augmentation --------------------------------------------------------------------

def draw(key: Column, seed: int, tag: str) -> Column:
    """Uniform integer in [0, 2^32) from md5(key|seed|tag)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}|{tag}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _pick(choices: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (idx + 1).cast("int"))


def augment(texts: DataFrame, key: Column, text: str, seed: int = 42,
            attack: list[str] | None = None) -> DataFrame:
    """One labelled sample per given text: (key, query, label, tid).

    Half of the texts stay safe, half of those with every '1' replaced by a
    number from 1 to 99; the other half get an attack template, drawn with
    replacement, after (3 in 10) or before the text. ``tid`` is the template's
    position (-1: none), useful for a split that keeps one template's samples
    on one side.
    """
    attack = ATTACK_TEMPLATES if attack is None else attack
    body = F.coalesce(F.col(text), F.lit(""))
    is_attack = draw(key, seed, "label") % 2 == 1
    ai = draw(key, seed, "attack") % len(attack)
    vary = draw(key, seed, "vary") % 10
    number = (draw(key, seed, "num") % 99 + 1).cast("string")
    safe_q = F.when(vary < int(SAFE_VARIED * 10), F.replace(body, F.lit("1"), number)).otherwise(body)
    attack_q = F.when(vary < int(ATTACK_PREFIXED * 10), F.concat(body, F.lit(" "), _pick(attack, ai))) \
                .otherwise(F.concat(_pick(attack, ai), F.lit(" "), body))
    return texts.select(
        key.cast("string").alias("key"),
        F.when(is_attack, attack_q).otherwise(safe_q).alias("query"),
        F.when(is_attack, F.lit(1)).otherwise(F.lit(0)).alias("label"),
        F.when(is_attack, ai).otherwise(F.lit(-1)).cast("int").alias("tid"),
    )


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The rows in a seeded random order, with the draw they are ordered by."""
    return df.withColumn("draw", draw(F.col(key), seed, "order")).orderBy("draw", key)


def load_corpus(spark: SparkSession, path: str | None = None, fmt: str = "csv",
                texts: DataFrame | None = None, text: str = "text", text_key: Column | None = None,
                key: str = "id", seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """(corpus(id, query, label), rejects or None).

    With a path, that file is the corpus: one that cannot be read, or whose
    columns do not resolve, raises. Without one the corpus is augmented from
    the given ``texts``.
    """
    if path:
        got = read_labelled(spark, path, fmt)
        if got is None:
            raise ValueError(f"no text and label column in {path}; accepted: {QUERY_NAMES} and {LABEL_NAMES}")
        good, bad = got
        # Stable key (no row ids exist in a file): hash of the text and its
        # file. Identical texts share a key and so land on one split side.
        return good.withColumn(key, F.xxhash64("query", F.input_file_name())), bad
    if texts is None:
        raise ValueError("give a labelled file or texts to augment")
    text_key = F.xxhash64(text) if text_key is None else text_key
    return augment(texts, text_key, text, seed).select(F.col("key").alias(key), "query", "label"), None

"""Helpers shared by the operators: cut points, hot-key joins, hash columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# White space and words as the operators read them: ASCII white space only.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are
#: fewer than HOT_SHARE hot keys however large the input is.
HOT_SHARE = 1000
#: Keys of fewer rows are never hot, however small the table.
HOT_ROWS = 1000
#: Rows up to which a per-key parameter table may be broadcast.
BROADCAST_ROWS = 100_000
#: The same for a table of one long column: at most about 64 MB of hash table.
BROADCAST_IDS = 2_000_000


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of this run below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that later passes neither recompute it nor depend on one
    executor's disk, and gives the planner its true size.
    """
    path = run_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's own setting: shuffle files go when the query that wrote them ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_free(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``cut`` that does not leave the shuffle files of the write behind.

    All that is read later is the written table, so a lost executor costs
    nothing more; without this the files stay until the driver collects garbage.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        return cut(df, name, compression)
    finally:
        conf.set(FREE_SHUFFLES, before)


def release(df: DataFrame) -> None:
    """Empty the tables of ``cut`` that ``df`` reads, once all that was made of
    them is written itself. A later read of ``df`` fails for want of its files."""
    none = df.sparkSession.createDataFrame([], "x long")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        none.write.mode("overwrite").parquet(path)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join to a table with one row per ``key``; hot keys are not shuffled.

    ``right[weight]`` is the number of left rows of the key. Keys above
    ``total / HOT_SHARE`` rows are fewer than HOT_SHARE, so that part of
    ``right`` has a proven bound and is broadcast; what it does not match has
    no hot key and takes the shuffle join. ``left`` is read twice, so it should
    be a cut table or cheap to read again.
    """
    is_hot = F.col(weight) > F.lit(max(HOT_ROWS, total // HOT_SHARE))
    cols = [c for c in right.columns if c != key]
    hot = right.where(is_hot)
    cold = right.where(~is_hot)
    known = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return known.select(*left.columns, *cols).unionByName(rest.select(*left.columns, *cols))


def bounded_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the counted ``rows`` are few; else a shuffle join
    (which adaptive execution splits for skewed keys)."""
    return F.broadcast(df) if rows <= most else df


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one-column cut table ``ids``.

    Wide rows stay where they are as long as the ids fit a bounded broadcast.
    """
    return df.join(bounded_broadcast(ids, ids.count(), BROADCAST_IDS), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The other rows of ``only_ids``, those of a NULL key included."""
    return df.join(bounded_broadcast(ids, ids.count(), BROADCAST_IDS), key, "left_anti")


def word_count(text: Column) -> Column:
    """Number of words, without building them: each becomes one mark."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (NULL for a NULL id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def slices(batch, columns: list[str], rows: int = 512):
    """Python lists of ``columns``, a few hundred rows at a time."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]

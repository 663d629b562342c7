"""Exact dedup by an extendible-hash index kept in shared files.

Texts are equal when their bytes are the same after deleting ASCII white
space. The index key is the leading bits of the SHA-256 of that text.

1. Every task deletes white space, folds equal texts among some 50,000 rows,
   or 16 MB of text, into one entry (compared by bytes) and writes its entries,
   with the bytes and the ids, to the shared folder. So a hot text leaves an
   entry for each such run of rows, and no list is longer than that.
2. The directory starts at depth 0 and doubles: an overfull bucket splits on
   the next key bit until it fits, or until no key bit is left. It is built
   from bytes per key prefix, read at 12 bits and again 4 bits deeper only
   below prefixes that are still overfull; the capacity follows the input, so
   the directory has a bounded number of buckets.
3. Owner tasks take whole buckets, that is key ranges, in key order. Entries
   of one key are chained: each is compared with the chain's texts by bytes,
   and joins the equal one or lengthens the chain.
4. Members look their group up by text hash; groups that hold over 1/1000 of
   all rows are fewer than 1000 and are broadcast, so no hot key is shuffled.

Defined results: NULL text counts as empty, and all empty texts are one
group. The row with the most code points in the original stays, then the
smallest doc_id (NULL last), then the first of repeated rows: of a repeated
row, one is kept. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, slices

KEY_BITS = 60                   # bits of the text hash that the index uses
FIRST_STEP, STEP = 12, 4        # key bits read at once while the directory grows
MIN_CAPACITY = 4 << 20          # bytes of a bucket below which it never splits
MAX_BUCKETS = 1 << 14           # buckets that the capacity aims at
BATCH_BYTES = 16 << 20          # text folded at once in a map task
BATCH_ROWS = 50_000             # rows folded at once, so of an entry's list

_DELETE = b" \t\n\x0b\x0c\r"

ENTRY = ("key long, sha string, body binary, ids array<bigint>, uids array<bigint>, "
         "rows long, best_len long, best_id long, best_uid long")
GROUP = "sha string, chain int, keep_id long, keep_uid long, group_size long"


def normalise(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _DELETE)


def _rank(length, doc_id, uid):
    """Smaller is better: long original, small id, NULL id last, first row."""
    return (-length, doc_id is None, doc_id or 0, uid)


def _entries(key_bits: int):
    """Fold equal texts of a batch; equal means equal bytes."""

    def flush(found):
        rows = []
        for body, (ids, uids, best) in found.items():
            sha = hashlib.sha256(body).hexdigest()
            rows.append((int(sha[:16], 16) >> (64 - key_bits), sha, body, ids, uids, len(ids),
                         -best[0], None if best[1] else best[2], best[3]))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                 pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["key", "sha", "body", "ids", "uids", "rows", "best_len", "best_id", "best_uid"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches):
        found, held, n_rows = {}, 0, 0
        for batch in batches:
            for ids, uids, texts in slices(batch, ["doc_id", "uid", "text"]):
                for doc_id, uid, text in zip(ids, uids, texts):
                    body, rank = normalise(text), _rank(len(text or ""), doc_id, uid)
                    got = found.get(body)
                    if got is None:
                        found[body] = ([doc_id], [uid], rank)
                        held += len(body)
                    else:
                        got[0].append(doc_id)
                        got[1].append(uid)
                        if rank < got[2]:
                            found[body] = (got[0], got[1], rank)
                n_rows += len(ids)  # repeats add no text, but to the lists of ids
                if held >= BATCH_BYTES or n_rows >= BATCH_ROWS:
                    yield flush(found)
                    found, held, n_rows = {}, 0, 0
        if found:
            yield flush(found)

    return run


def build_directory(entries: DataFrame, key_bits: int, min_capacity: int, max_buckets: int) -> list[int]:
    """First key of every bucket, in order. Buckets are key prefixes."""
    size = F.length("body") + F.lit(64)
    total = entries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    capacity = max(min_capacity, total // max_buckets)
    starts, depth, overfull = {0}, 0, None
    while depth < key_bits and total > capacity:
        step = min(STEP if depth else FIRST_STEP, key_bits - depth)
        shift = key_bits - depth - step
        rows = entries.select(F.shiftright("key", shift).alias("p"), size.alias("n"))
        if overfull is not None:  # fewer than total / capacity prefixes
            rows = rows.where(F.shiftright("p", step).isin(overfull))
        counts = dict(rows.groupBy("p").agg(F.sum("n")).collect())  # 2^12, or 2^4 a prefix
        overfull = []
        for parent in {p >> step for p in counts}:
            below = defaultdict(int)  # bytes below each prefix of 0..step more bits
            for p, n in counts.items():
                if p >> step == parent:
                    for bits in range(step + 1):
                        below[bits, p >> (step - bits)] += n
            todo = [(0, parent)]
            while todo:  # split on one more bit: the directory doubles where needed
                bits, prefix = todo.pop()
                if below[bits, prefix] > capacity and bits < step:
                    todo += [(bits + 1, 2 * prefix), (bits + 1, 2 * prefix + 1)]
                    starts.add((2 * prefix + 1) << (shift + step - bits - 1))
                elif below[bits, prefix] > capacity:
                    overfull.append(prefix)
        if not overfull:
            break
        depth += step
    return sorted(starts)


def _chain(batches):
    """Rows sorted by key: chain the texts of a key, compare bytes."""
    key, chain = None, []
    out = []

    def close():
        for n, (sha, _, rows, best) in enumerate(chain):
            out.append((sha, n, None if best[1] else best[2], best[3], rows))

    def emit():
        cols = list(zip(*out))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                           names=["sha", "chain", "keep_id", "keep_uid", "group_size"])
        out.clear()
        return batch

    for batch in batches:
        for rows in slices(batch, ["key", "sha", "body", "rows", "best_len", "best_id", "best_uid"]):
            for k, sha, body, n, length, doc_id, uid in zip(*rows):
                if k != key:
                    close()
                    key, chain = k, []
                rank = _rank(length, doc_id, uid)
                for at, (_, known, count, best) in enumerate(chain):
                    if known == body:
                        chain[at] = (sha, known, count + n, min(best, rank))
                        break
                else:
                    chain.append((sha, body, n, rank))
            if len(out) >= 4096:
                yield emit()
    close()
    if out:
        yield emit()


def exact_dedup(docs: DataFrame, key_bits: int = KEY_BITS, min_capacity: int = MIN_CAPACITY,
                max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.monotonically_increasing_id().alias("uid"))
    entries = cut(rows.mapInArrow(_entries(key_bits), ENTRY), "dedup-entries")
    starts = np.array(build_directory(entries, key_bits, min_capacity, max_buckets), dtype=np.int64)

    def owner(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.append_column("bucket", pa.array(np.searchsorted(starts, keys, "right") - 1, pa.int32()))

    owned = (entries.select("key", "sha", "body", "rows", "best_len", "best_id", "best_uid")
             .mapInArrow(owner, "key long, sha string, body binary, rows long, best_len long, best_id long, "
                                "best_uid long, bucket int"))
    index = cut(owned.repartition(F.col("bucket")).sortWithinPartitions("key", "sha").drop("bucket")
                .mapInArrow(_chain, GROUP), "dedup-index")
    total = entries.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    members = cut(entries.select("sha", F.explode(F.arrays_zip("ids", "uids")).alias("m"))
                  .select("sha", F.col("m.ids").alias("doc_id"), F.col("m.uids").alias("uid")), "dedup-members")
    joined = join_hot(members, index.drop("chain"), "sha", "group_size", total)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
                         F.col("sha").alias("text_sha256"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS body FROM documents),
g AS (
  SELECT doc_id, sha256(body) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""

"""Packing token sequences: first-fit decreasing over a tournament tree.

``pieces`` encodes every document, adds an end id and cuts it at multiples of
the sequence length. Full pieces are sequences of their own. The rest, one
piece of a document at most, are dealt by a hash of their number into
randomised groups of about ``group_size``, and each group is packed on its own:
the longest piece first, into the first bin with room for it. The bins' rooms
are the leaves of a tournament tree whose inner nodes hold the larger child, so
the first bin that fits is found by one descent. A group leaves about one bin
partly empty, whatever the size of the table, so padding is about one sequence
in ``group_size`` pieces.

The pieces are written to the shared folder once, with a number each; groups,
sequences and offsets follow from the written table alone, so tasks that run
again give the same. Only rows of a few numbers are shuffled by the report;
``sequences`` moves the ids as well.

Defined results: NULL text counts as empty, so its document is the end id alone;
a NULL doc_id is kept; repeated rows are documents of their own; pieces of equal
length go by doc_id, then by number; a long text has as many pieces as it needs;
special tokens that the tokenizer file lists are matched in the text; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import cut, slices

SEQUENCE = 2048          # most tokens of a sequence
GROUP = 4096             # pieces packed together
END_ID = 1               # id after each document
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


class FirstFit:
    """Bins of equal capacity; ``add`` puts a length into the first bin with room."""

    def __init__(self, capacity: int, most: int):
        """``most``: number of lengths to come, so of bins at most."""
        self.capacity = capacity
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)  # of node i the children are 2i and 2i + 1

    def add(self, length: int) -> tuple[int, int]:
        """(bin, offset within it)."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        offset = self.capacity - room[i]
        room[i] -= length
        bin_, i = i - self.leaves, i >> 1
        while i:
            larger = max(room[2 * i], room[2 * i + 1])
            if larger == room[i]:
                break
            room[i] = larger
            i >>= 1
        return bin_, offset


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each of the lengths, which fall."""
    bins = FirstFit(capacity, len(lengths))
    return [bins.add(n) for n in lengths]


class Tokens:
    """Text to ids. Pieces merge by the ids' order, which is the merge order."""

    def __init__(self, path: str):
        v = bpe.vocabulary(path)
        ranks = {raw: i for i, raw in v.token_of.items() if i not in set(v.special.values())}
        self.path = path
        self.encoding = tiktoken.Encoding("packing", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens=v.special)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.encoding.encode_to_numpy(text, allowed_special="all"), "<u4")
        except ValueError:  # a run of white space beyond the splitter's stack: the streaming encoder has none
            return np.frombuffer(b"".join(bpe.encoder(self.path).encode(text)), "<u4")


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each document cut at multiples
    of ``size``; ids are packed as little-endian 32-bit integers."""

    def run(batches):
        encode, end = tokens(path), np.array([end_id], "<u4")
        for batch in batches:
            for doc_ids, texts in slices(batch, ["doc_id", "text"], 128):
                rows = []
                for doc_id, text in zip(doc_ids, texts):
                    ids = np.concatenate([encode(text or ""), end])
                    rows += [(doc_id, at, min(size, len(ids) - at), len(ids), ids[at:at + size].tobytes())
                             for at in range(0, len(ids), size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def place(cut_pieces: DataFrame, size: int = SEQUENCE, group_size: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``size`` tokens.

    ``cut_pieces`` has doc_id, length and a unique number ``piece``, and is a
    written table: it is read for the count, the full pieces and the others.
    """
    rest = cut_pieces.where(F.col("length") < size)
    n_groups = max(1, math.ceil(rest.count() / group_size))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        placed = first_fit_decreasing(table["length"].to_pylist(), size)
        base = table["group"][0].as_py() << 32
        table = table.append_column("sequence_id", pa.array([2 * (base + b) for b, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([at for _, at in placed], pa.int64())).drop_columns(["group"])

    def typed(df):
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    packed = (rest.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(n_groups))).groupBy("group")
              .applyInArrow(run, f"{typed(rest)}, sequence_id long, offset long"))
    full = (cut_pieces.where(F.col("length") == size)
            .withColumn("sequence_id", 2 * F.col("piece") + 1).withColumn("offset", F.lit(0).cast("long")))
    return full.unionByName(packed)


def _numbered(rows: DataFrame) -> DataFrame:
    return cut(rows.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def sequences(docs: DataFrame, path: str, size: int = SEQUENCE, group_size: int = GROUP) -> DataFrame:
    """(sequence_id, n_tokens, ids, spans): the packed ids of each sequence and
    the pieces it holds, in order, as (offset, doc_id, start, length)."""
    placed = place(_numbered(pieces(docs, path, size)), size, group_size)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))  # `size` rows at most
    joined = F.aggregate("parts", F.lit(b""), lambda held, p: F.concat(held, p["ids"]))
    return (placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
            .select("sequence_id", "n_tokens", joined.alias("ids"),
                    F.transform("parts", lambda p: p.dropFields("ids")).alias("spans")))


def report(docs: DataFrame, path: str, size: int = SEQUENCE, group_size: int = GROUP) -> DataFrame:
    """Each piece with its place: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    rows = pieces(docs, path, size).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(_numbered(rows), size, group_size).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

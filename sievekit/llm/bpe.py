"""Byte-level BPE as a streaming transducer, and an incremental decoder.

``sufficient_lookahead`` derives from the merge list how many bytes to the
right can still change whether a boundary stays. A merge (u, v) removes the
boundary between u and v unless an earlier merge first joins the right end of
v to what follows; the left part of that merge is v or a token on the right
edge of v's own merge tree. Priorities fall along such a chain, so one pass
over the merges in order gives the longest chain in bytes. Boundaries at
least that far from the end of the bytes seen are final, and a text may be
cut at a final boundary.

``Encoder`` splits text into pieces block by block, merges a short piece
directly (recent ones come from a bounded table) and runs longer ones through
a window of fixed size that emits a token as soon as its end is stable.
Memory is constant in the length of the text. ``Decoder`` maps ids to bytes
and feeds them to an incremental UTF-8 machine whose state is at most three
pending bytes.

Defined results: NULL text counts as empty (no tokens); special tokens that
the tokenizer file lists are matched in the text first; repeated rows are
encoded alike; extra columns are ignored by the report; an empty table gives
no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Fixed value: the split pattern of byte-level BPE vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BLOCK = 1 << 16          # characters split at once
TABLE_SIZE = 1 << 17     # pieces kept in each of two generations of recent pieces
TABLE_PIECE = 48         # longest piece kept there, in characters
NO_RANK = 1 << 62
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: itself, or the next character from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in own}
    for n, b in enumerate(sorted(set(range(256)) - set(own))):
        table[chr(256 + n)] = b
    return table


LATIN_END = 0x250        # texts below it are split with spelled-out classes


def latin_split() -> re.Pattern:
    """The split pattern for texts of code points below LATIN_END, its classes
    spelled out from the general ones; the plainer engine takes half the time."""

    def spelled(general: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN_END) if regex.match(general, chr(c)))

    letter, number, space = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
                      f"|[{space}]+(?![^{space}])|[{space}]+")


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(alphabet[c] for c in token)

        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: raw(t) for t, i in vocab.items() if t not in self.special}
        self.token_of.update({i: t.encode() for t, i in self.special.items()})
        self.byte_id = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges = {}  # (left id, right id) -> (rank, merged id)
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.rank_of = {a << 32 | b: rank for (a, b), (rank, _) in self.merges.items()}
        self.merged_of = [m for _, m in sorted(self.merges.values())]
        self.longest = max(map(len, self.token_of.values()))
        self.lookahead = sufficient_lookahead(self.merges, self.token_of)


def sufficient_lookahead(merges: dict, token_of: dict) -> int:
    """Bytes after a boundary that can still decide whether it stays."""
    right_of = {}            # right child of a merged token, by its first merge
    reach_of: dict[int, int] = {}  # longest chain that starts with this left part
    most = 0
    for (left, right), (_, merged) in sorted(merges.items(), key=lambda x: x[1][0]):
        further, edge = 0, right
        while edge is not None:
            further = max(further, reach_of.get(edge, 0))
            edge = right_of.get(edge)
        reach = len(token_of[right]) + further
        reach_of[left] = max(reach_of.get(left, 0), reach)
        most = max(most, reach)
        right_of.setdefault(merged, right)
    return most


def merge_short(ids: list[int], rank_of: dict, merged_of: list[int]) -> list[int]:
    """Apply the merges to a short list: lowest rank first, left to right."""
    get = rank_of.get
    ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
    while ranks:
        rank = min(ranks)
        if rank == NO_RANK:
            break
        i = ranks.index(rank)
        ids[i] = merged_of[rank]
        del ids[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(ids[i] << 32 | ids[i + 1], NO_RANK)
        if i:
            ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], NO_RANK)
    return ids


def merge_window(ids: list[int], merges: dict) -> list[int]:
    """The same for a window of bytes, with a heap: n log n."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        ids[i], ids[j] = merged, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if m := merges.get((merged, ids[after[j]])):
                heapq.heappush(heap, (m[0], i, merged, ids[after[j]], m[1]))
        if before[i] >= 0 and (m := merges.get((ids[before[i]], merged))):
            heapq.heappush(heap, (m[0], before[i], ids[before[i]], merged, m[1]))
    return [t for t in ids if t != -1]


class _Recent(dict):
    """Piece -> packed ids, filled on demand. When full, it becomes the older
    generation, from which pieces still in use come back."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = [*map(self.v.byte_id.__getitem__, piece.encode())]
            ids = (merge_short(ids, self.v.rank_of, self.v.merged_of) if len(ids) <= 256
                   else merge_window(ids, self.v.merges))
            packed = array("I", ids).tobytes()
        if len(piece) <= TABLE_PIECE:
            if len(self) >= TABLE_SIZE:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    """Text to packed ids (32-bit little-endian), block by block."""

    def __init__(self, vocabulary: Vocabulary, window: int = 4096):
        self.v = vocabulary
        self.window = max(window, vocabulary.lookahead + vocabulary.longest + 1)
        self.recent = _Recent(vocabulary)
        self.split = regex.compile(SPLIT)
        self.latin, self.beyond = latin_split(), re.compile(f"[^\0-{chr(LATIN_END - 1)}]")
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None

    def encode(self, text: str, block: int = BLOCK):
        """Yield packed ids; each yield ends at a stable token boundary."""
        at = 0
        if self.special:
            for m in self.special.finditer(text):
                yield from self._plain(text, at, m.start(), block)
                yield array("I", [self.v.special[m[0]]]).tobytes()
                at = m.end()
        yield from self._plain(text, at, len(text), block)

    def _plain(self, text: str, at: int, end: int, block: int):
        split = self.split if self.beyond.search(text, at, end) else self.latin
        if end - at <= block:
            if at < end:
                yield b"".join(map(self.recent.__getitem__, split.findall(text, at, end)))
            return
        block = max(block, 3)  # two pieces taken back leave one
        while at < end:
            stop = min(end, at + block)
            pieces = split.findall(text, at, stop)
            if stop < end:
                if len(pieces) == 1:  # a piece longer than a block: find its end, stream it
                    done = split.match(text, at, end).end()
                    yield from self._stream(text, at, done)
                    at = done
                    continue
                stop -= (cut := len(pieces.pop()))  # what follows the block could change the last piece
                if cut == 1 and pieces[-1] == "'":  # and join it to an apostrophe: 're, 've, 'll
                    stop -= len(pieces.pop())
            yield b"".join(map(self.recent.__getitem__, pieces))
            at = stop

    def _stream(self, text: str, at: int, end: int):
        """One long piece through a window; emit tokens that end where bytes
        still to come cannot change them."""
        v, held = self.v, b""
        while at < end or held:
            take = min(end, at + self.window)
            held += text[at:take].encode()
            at = take
            last = at >= end
            ids = merge_window([v.byte_id[b] for b in held], v.merges)
            stable, done, n = len(held) if last else len(held) - v.lookahead, 0, 0
            for t in ids:
                if done + len(v.token_of[t]) > stable:
                    break
                done += len(v.token_of[t])
                n += 1
            yield array("I", ids[:n]).tobytes()
            held = held[done:]


class Decoder:
    """Ids to text; invalid bytes become U+FFFD, split characters wait."""

    def __init__(self, vocabulary: Vocabulary):
        self.token_of = vocabulary.token_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes, last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.token_of.__getitem__, memoryview(packed).cast("I"))), last)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def digest(text: str | None, path: str) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids, digest of the text they decode to."""
    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
    decoder = Decoder(vocabulary(path))
    for packed in encoder(path).encode(text or ""):
        n += len(packed) >> 2
        ids_hash.update(packed)
        text_hash.update(decoder.feed(packed).encode())
    text_hash.update(decoder.feed(b"", True).encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encode_ids(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All input columns and ``ids``: the tokens of the text, packed as
    little-endian 32-bit integers (a binary value of at most 2 GB)."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            ids = pa.array([b"".join(e.encode(t or "")) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], ids], names=[*batch.schema.names[:at], "_ids"])

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       F.col(text_col).alias("_text"))
    out = held.mapInArrow(run, f"_doc {held.schema['_doc'].dataType.simpleString()}, _ids binary")
    return out.select("_doc.*", F.col("_ids").alias("ids"))


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch, ["doc_id", "text"]):
                n, ids_sha, text_sha = zip(*[digest(t, path) for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                     pa.array(text_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)

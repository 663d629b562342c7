"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model with absolute discounting over all words of the
training documents. As an automaton: the root and every word seen in training
are states; a state has an arc for every word that followed it, weighted with
the smoothed bigram probability; any other word takes the state's failure arc
to the root, weighted with the mass its discounts left over, and then the
root's arc, the add-half unigram. A text is one left-to-right traversal that
carries the state and adds up log10 weights.

Nothing of the model is held whole in one place:

1. Documents are packed into chunks of bounded size, a table in the shared
   folder. Rows of a chunk stay together from here on.
2. Every chunk sends its distinct (word, next word) pairs with their training
   counts, as packed blocks by word hash, to counting tasks. Words that a
   sample shows to be frequent are dealt out by next word instead, so that no
   word's followers meet in one task.
3. A counting task adds up its blocks and answers each block in its own
   order: pair counts, and each word's count and number of distinct
   followers. Totals of the corpus are native sums of one row per task, those
   of frequent words a bounded table.
4. A chunk meets its answers again, which are exactly the states and arcs its
   texts can visit, and is traversed.

Words are 64-bit hashes; in a pair the next word has 40 bits, compared only
within one first word.

Defined results: NULL text counts as empty and has the end token only; a
NULL doc_id is not held out and trains; repeated rows count as often as they
occur; without training documents every token has its add-half share; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_bucket
from .words import hashes_by_text

FOLDS, HELD_OUT = 5, 1       # crc32 of the id modulo 5 is 1: never trained on
CHUNK_BYTES = 4 << 20        # text of a chunk
PART_BYTES = 12 << 20        # corpus text whose pairs a counting task takes
SAMPLE_CHUNKS = 64           # chunks from which frequent words are recognised
FREQUENT = 1 / 2000          # share of the sample's words

START, END = np.uint64(1), np.uint64(2)
_W40 = np.uint64((1 << 40) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


# --- chunks -----------------------------------------------------------------------

def _pack_chunks(batches):
    """Rows of (doc_id, held_out, text) into chunks: Arrow streams, compressed."""
    task, n = TaskContext.get().partitionId(), 0
    held, size = [], 0

    def close():
        rows = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        return pa.RecordBatch.from_pydict(
            {"chunk": pa.array([task << 32 | n], pa.int64()), "bytes": pa.array([size], pa.int64()),
             "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy().astype(np.int64) + 16
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), CHUNK_BYTES - size, "right")
            take = max(int(room), 0 if held else 1)
            if take:
                held.append(batch.slice(at, take))
                size += int(sizes[at:at + take].sum())
                at += take
            if at < batch.num_rows or size >= CHUNK_BYTES:
                yield close()
                held, size, n = [], 0, n + 1
    if held:
        yield close()


def _open_chunk(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def _words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and how many each has."""
    raws = [(t or "").encode().lower() for t in rows["text"].to_pylist()]  # bytes: A-Z only
    hashes, counts = hashes_by_text(raws)
    return np.maximum(hashes, np.uint64(3)), counts


@dataclass
class _Pairs:
    """A chunk's tokens with the word before each, as ids into ``words``."""

    words: np.ndarray      # distinct hashes, sorted
    keys: np.ndarray       # id before * len(words) + id, for every token
    sizes: np.ndarray      # tokens of each document


def _pairs(rows: pa.Table) -> _Pairs:
    hashes, counts = _words(rows)
    sizes = counts + 1
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    flow = np.empty(int(sizes.sum()) + len(sizes), np.uint64)  # START, words, END of each document
    token = np.ones(len(flow), bool)
    token[starts] = False
    inner = token.copy()
    inner[starts + sizes] = False
    flow[starts], flow[starts + sizes], flow[inner] = START, END, hashes
    distinct, ids = np.unique(flow, return_inverse=True)
    here = np.flatnonzero(token)
    return _Pairs(distinct, ids[here - 1] * np.int64(len(distinct)) + ids[here], sizes)


# --- blocks ---------------------------------------------------------------------

def _planes(x: np.ndarray, width: int) -> bytes:
    """Low ``width`` bytes of each number, one byte position after the other."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    head = np.array([len(x) for x, _ in columns], "<u8").tobytes()
    return head + b"".join(_planes(x, w) for x, w in columns)


def _unpack(raw: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    view, at, out = memoryview(raw), 8 * len(widths), []
    for n, w in zip(np.frombuffer(raw, "<u8", len(widths)).tolist(), widths):
        out.append(_unplanes(view[at:at + n * w], n, w))
        at += n * w
    return out


BLOCK = (8, 4, 5, 4)    # gaps of the words, pairs of each word, next words, counts
ANSWER = (5, 5, 5)      # pair counts; count and distinct followers of each word


def _parts(first: np.ndarray, second: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    """Counting task of each pair."""
    spread = np.isin(first, frequent)
    return (np.where(spread, second * _MIX, first * _MIX) >> np.uint64(24)) % np.uint64(n)


def _by_part(first, second, frequent, n):
    """(part, positions) for each part of pairs in (first, second) order."""
    part = _parts(first, second, frequent, n)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(n + 1))
    return [(k, order[edges[k]:edges[k + 1]]) for k in range(n) if edges[k] < edges[k + 1]]


def _distinct_pairs(p: _Pairs, trains: np.ndarray | None):
    """Sorted distinct keys, and how often each occurs in training documents."""
    if trains is None:
        return np.unique(p.keys), None
    flagged = np.sort(p.keys * 2 + np.repeat(trains, p.sizes))
    keys = flagged >> 1
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(flagged & 1, first)


def _send(n_parts: int, frequent: np.ndarray):
    """Chunks to (part, chunk, block)."""

    def run(batches):
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _open_chunk(body.as_py())
                p = _pairs(rows)
                trains = ~rows["held_out"].to_numpy()
                keys, counts = _distinct_pairs(p, trains)
                first, second = p.words[keys // len(p.words)], p.words[keys % len(p.words)] & _W40
                parts, blocks = [], []
                for part, at in _by_part(first, second, frequent, n_parts):
                    own = first[at]
                    runs = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    head = own[runs]
                    parts.append(part)
                    blocks.append(_pack((np.diff(head, prepend=np.uint64(0)), BLOCK[0]),
                                        (np.diff(np.append(runs, len(own))), BLOCK[1]),
                                        (second[at], BLOCK[2]), (counts[at], BLOCK[3])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.int32()), pa.array([chunk] * len(parts), pa.int64()),
                     pa.array(blocks, pa.binary())], names=["part", "chunk", "block"])

    return run


COUNTED = ("chunk long, part int, answer binary, tokens long, types long, once long, twice long, "
           "frequent array<struct<word:long,count:long,followers:long>>")


def _count(frequent: np.ndarray):
    """Blocks of one part after the other to answers, and a row of totals."""
    some = pa.list_(pa.struct([("word", pa.int64()), ("count", pa.int64()), ("followers", pa.int64())]))

    def table(chunks, part, answers, totals=(None,) * 5):
        n = len(chunks)
        return pa.RecordBatch.from_arrays(
            [pa.array(chunks, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(answers, pa.binary()),
             *(pa.array([t] * n, pa.int64()) for t in totals[:4]), pa.array([totals[4]] * n, some)],
            names=["chunk", "part", "answer", "tokens", "types", "once", "twice", "frequent"])

    def add_up(part, chunks, blocks):
        opened = [_unpack(b, BLOCK) for b in blocks]
        heads = [np.cumsum(o[0], dtype=np.uint64) for o in opened]
        first = np.concatenate([np.repeat(h, o[1].astype(np.int64)) for h, o in zip(heads, opened)])
        second = np.concatenate([o[2] for o in opened])
        count = np.concatenate([o[3] for o in opened]).astype(np.int64)
        order = np.lexsort((second, first))
        first_s, second_s = first[order], second[order]
        new_word = np.concatenate([[True], first_s[1:] != first_s[:-1]])
        new_pair = new_word | np.concatenate([[True], second_s[1:] != second_s[:-1]])
        pair_at, word_at = np.flatnonzero(new_pair), np.flatnonzero(new_word)
        total = np.add.reduceat(count[order], pair_at)
        in_word = np.searchsorted(pair_at, word_at)  # first pair of each word
        word_total = np.add.reduceat(total, in_word)
        followers = np.add.reduceat((total > 0).astype(np.int64), in_word)
        words_ = first_s[word_at]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new_pair) - 1
        pair_count = total[back]
        answers, lo = [], 0
        for h, o in zip(heads, opened):
            n = len(o[2])
            i = np.searchsorted(words_, h)
            answers.append(_pack((pair_count[lo:lo + n], ANSWER[0]), (word_total[i], ANSWER[1]),
                                 (followers[i], ANSWER[2])))
            lo += n
        yield table(chunks, part, answers)
        hot = np.isin(words_, frequent)
        shares = [{"word": int(w), "count": int(c), "followers": int(f)} for w, c, f in
                  zip(words_[hot].view(np.int64), word_total[hot], followers[hot])]
        yield table([None], part, [None], (int(word_total.sum()), int((word_total[~hot] > 0).sum()),
                                           int((total == 1).sum()), int((total == 2).sum()), shares))

    def run(batches):
        part, chunks, blocks = None, [], []
        for batch in batches:
            for now, chunk, block in zip(*(c.to_pylist() for c in batch.columns)):
                if now != part and blocks:
                    yield from add_up(part, chunks, blocks)
                    chunks, blocks = [], []
                part = now
                chunks.append(chunk)
                blocks.append(block)
        if blocks:
            yield from add_up(part, chunks, blocks)

    return run


# --- the automaton ----------------------------------------------------------------

@dataclass
class Totals:
    """Of the training documents, the end token included."""

    documents: int
    tokens: int            # N
    types: int             # V
    discount: float


@dataclass
class Automaton:
    """The states and arcs that one chunk can visit.

    State ids are word ids, the start among them; a state without training
    count is the root. ``arcs`` are sorted keys (state * words + word).
    """

    words: int
    arcs: np.ndarray          # keys
    arc_count: np.ndarray
    state_count: np.ndarray
    followers: np.ndarray
    root_share: np.ndarray    # the root's arc for each word: its unigram share
    discount: float

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 weight of each arc, of each failure arc, of each root arc."""
        state, word = self.arcs // self.words, self.arcs % self.words
        n = np.maximum(self.state_count, 1)
        left = np.where(self.state_count > 0, self.discount * self.followers / n, 1.0)
        seen = np.maximum(self.arc_count - self.discount, 0) / n[state]
        arc = np.where(self.arc_count > 0, seen + left[state] * self.root_share[word], 0)
        with np.errstate(divide="ignore"):
            return np.log10(arc), np.log10(left), np.log10(self.root_share)

    def traverse(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log10 probability of each document.

        After a word the automaton is in the word's own state, so the state
        carried along is the word before, which ``keys`` holds: take its arc
        if there is one, else its failure arc and the root's.
        """
        arc, failure, root = self.weights()
        at = np.searchsorted(self.arcs, keys)
        taken = self.arc_count[at] > 0
        steps = np.where(taken, arc[at], failure[keys // self.words] + root[keys % self.words])
        return np.add.reduceat(steps, np.cumsum(sizes) - sizes)


def _score(n_parts: int, frequent: np.ndarray, shared):
    """Answers of a chunk, then the chunk itself, to scores."""

    def score(body, answers):
        totals, hot = shared.value
        rows = _open_chunk(body)
        p = _pairs(rows)
        n = len(p.words)
        keys, _ = _distinct_pairs(p, None)
        first, second = p.words[keys // n], p.words[keys % n] & _W40
        pair_count = np.zeros(len(keys), np.int64)
        count, followers = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for part, at in _by_part(first, second, frequent, n_parts):
            pairs_, words_, follow = _unpack(answers[part], ANSWER)
            ids = keys[at] // n
            ids = ids[np.concatenate([[True], ids[1:] != ids[:-1]])]
            pair_count[at], count[ids], followers[ids] = pairs_, words_, follow
        for word, c, f in hot:  # their followers were dealt out by next word
            i = np.searchsorted(p.words, word)
            if i < n and p.words[i] == word:
                count[i], followers[i] = c, f
        uses = count.copy()  # as a token: the end counts documents, the start nothing
        uses[p.words == END] = totals.documents
        uses[p.words == START] = 0
        share = (uses + 0.5) / (totals.tokens + 0.5 * (totals.types + 1))
        model = Automaton(n, keys, pair_count, count, followers, share, totals.discount)
        starts = np.cumsum(p.sizes) - p.sizes
        token = p.keys % n
        return pa.RecordBatch.from_arrays(
            [rows["doc_id"].combine_chunks(), rows["held_out"].combine_chunks(), pa.array(p.sizes, pa.int64()),
             pa.array(np.add.reduceat((uses[token] > 0).astype(np.int64), starts)),
             pa.array(np.full(len(p.sizes), totals.tokens), pa.int64()),
             pa.array(np.add.reduceat(np.log10(share)[token], starts)),
             pa.array(model.traverse(p.keys, p.sizes))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches):
        answers = {}
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part is None:  # the chunk comes after its answers
                    yield score(body.as_py(), answers)
                    answers = {}
                else:
                    answers[part] = body.as_py()

    return run


def _frequent(chunks: DataFrame, n_chunks: int) -> np.ndarray:
    """Hashes of words that a sample of chunks shows to be frequent, and the
    start. Only the dealing depends on them, no result does."""

    def run(batches):
        for batch in batches:
            for body in batch.column(0):
                found, n = np.unique(_words(_open_chunk(body.as_py()))[0], return_counts=True)
                some = n >= max(2, FREQUENT / 2 * n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[some].view(np.int64)), pa.array(n[some], pa.int64())], names=["word", "n"])

    every = -(-n_chunks // SAMPLE_CHUNKS)
    sample = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(max(1, every))) == 0)
    size = sample.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] / 6  # about a word in 6 bytes
    got = (sample.select("body").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= max(2, FREQUENT * size)).select("word").collect())  # a few thousand at most
    return np.append(np.array([r.word for r in got], np.int64).view(np.uint64), START)


def lm_score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per document: tokens, known tokens, base and model scores."""
    spark = docs.sparkSession
    aside = F.coalesce(id_bucket(F.col("doc_id"), folds) == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), aside.alias("held_out"), "text")
    chunks = cut(rows.mapInArrow(_pack_chunks, "chunk long, bytes long, body binary"), "lm-chunks", "none")
    n_chunks, size = chunks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_parts = max(8, -(-size // PART_BYTES))
    frequent = _frequent(chunks, n_chunks)
    blocks = chunks.select("chunk", "body").mapInArrow(_send(n_parts, frequent), "part int, chunk long, block binary")
    counted = cut(blocks.repartition(F.col("part")).sortWithinPartitions("part", "chunk")
                  .mapInArrow(_count(frequent), COUNTED), "lm-counted")
    n, v, once, twice = counted.where("chunk IS NULL").agg(
        *(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once", "twice"))).first()
    shares = (counted.where("chunk IS NULL").select(F.explode("frequent").alias("f"))
              .groupBy("f.word").agg(F.sum("f.count").alias("count"), F.sum("f.followers").alias("followers")).collect())
    hot = [(np.int64(r.word).view(np.uint64), r["count"], r.followers) for r in shares]
    # Pairs that start documents count documents; every other pair counts a word.
    n_docs = next((c for w, c, _ in hot if w == START), 0)
    words_seen = sum(1 for w, c, _ in hot if c and w != START)
    totals = Totals(n_docs, n, v + words_seen + (n_docs > 0),
                    once / (once + 2 * twice) if once else 0.5)
    shared = spark.sparkContext.broadcast((totals, hot))
    both = counted.where("chunk IS NOT NULL").select("chunk", "part", F.col("answer").alias("body")).unionByName(
        chunks.select("chunk", F.lit(None).cast("int").alias("part"), "body"))
    return (both.repartition(F.col("chunk")).sortWithinPartitions("chunk", F.col("part").asc_nulls_last())
            .select("part", "body").mapInArrow(_score(n_parts, frequent, shared), SCHEMA))

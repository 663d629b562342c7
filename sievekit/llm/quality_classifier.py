"""Quality classifier: random-indexing word vectors and a small network.

Random indexing: every word bucket and every shape (letters, digits and marks
of a word, runs folded) owns a fixed sparse ternary index vector; its context
vector is the sum of the index vectors found up to two places away, over the
whole corpus. Tasks add up integers for their rows, a partial aggregate adds
the tasks; the table has a fixed number of buckets, so it may be broadcast.

A document is pooled from the unit vectors of its words and shapes: mean,
spread, and mean step between neighbours (repetition makes it small), with
the logarithm of its length. A two-layer numpy network is fitted on about
``train_rows`` labelled documents (a bound, and a parameter) outside the held
out ids, and its temperature on a fifth of them set aside.

Defined results: NULL or empty text is scored like any other, from a zero
pool; without labelled rows of both kinds the score is the share of label 1
(0.5 without labels); a NULL doc_id is not held out; repeated rows score
alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket
from .labelled import holdout, labelled_sample, sigmoid
from .words import SPACE, groups, word_bounds, word_hashes

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 13, 1 << 9
DIMS = 32
NEAR = (1, 2)              # distances at which words are context
TRAIN_ROWS = 12_000
FOLDS, HELD_OUT = 3, 1     # crc32 of the id modulo 3 is 1: never trained on
HIDDEN = 48
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASS = np.array([ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b > 127 else
                   ord("0") if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def shapes(b: np.ndarray) -> np.ndarray:
    """Bytes as letter, digit or mark, runs of one folded: 'Thre*** EDTH!!'
    gives 'Aa* A!'. Words stay words."""
    kind = _CLASS[b]
    kind[SPACE[b]] = 32
    return kind[np.concatenate([[True], kind[1:] != kind[:-1]])] if len(kind) else kind


def streams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape bucket of all words of the texts in a row, and
    the text each is from."""
    words, forms, docs, at = [], [], [], 0
    for group in groups([(t or "").encode() for t in texts]):
        b = np.frombuffer(b"\n".join(group), np.uint8)
        starts, ends = word_bounds(b)
        words.append(word_hashes(b, starts, ends) % np.uint64(WORD_BUCKETS))
        folded = shapes(b)
        forms.append(word_hashes(folded, *word_bounds(folded)) % np.uint64(SHAPE_BUCKETS))
        after = np.cumsum([len(raw) + 1 for raw in group])
        docs.append(np.searchsorted(after, starts, "right") + at)
        at += len(group)
    if not words:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(words).astype(np.int64), np.concatenate(forms).astype(np.int64), np.concatenate(docs)


def index_places(buckets: int, seed: int) -> np.ndarray:
    """Places of +1 and of -1 in each bucket's index vector."""
    return np.random.default_rng(seed).permuted(np.tile(np.arange(DIMS), (buckets, 1)), axis=1)[:, :2]


PLACES = (index_places(WORD_BUCKETS, 7), index_places(SHAPE_BUCKETS, 8))


class Contexts:
    """Sums of context index vectors, as integers."""

    def __init__(self):
        self.sums = [np.zeros(n * DIMS) for n in (WORD_BUCKETS, SHAPE_BUCKETS)]

    def add(self, streams, doc: np.ndarray) -> None:
        """Bucket streams of several documents; ``doc`` tells them apart."""
        for total, places, at in zip(self.sums, PLACES, streams):
            for d in NEAR:
                same = doc[d:] == doc[:-d]
                left, right = at[:-d][same], at[d:][same]
                for one, other in ((left, right), (right, left)):
                    for k, sign in enumerate((1.0, -1.0)):
                        found = np.bincount(one * DIMS + places[other, k], minlength=len(total))
                        total += sign * found

    def batch(self) -> pa.RecordBatch:
        rows = np.concatenate([t.reshape(-1, DIMS) for t in self.sums]).astype(np.int64)
        some = np.flatnonzero(rows.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), *(pa.array(rows[some, k]) for k in range(DIMS))],
            names=["bucket", *(f"c{k}" for k in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vector of every bucket, from the whole corpus."""

    def run(batches):
        contexts, some = Contexts(), False
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                *both, doc = streams(batch.slice(at, 256).column(0).to_pylist())
                contexts.add(both, doc)
                some = True
        if some:
            yield contexts.batch()

    kind = "bucket int, " + ", ".join(f"c{k} long" for k in range(DIMS))
    sums = docs.select("text").mapInArrow(run, kind).groupBy("bucket").agg(
        *(F.sum(f"c{k}").alias(f"c{k}") for k in range(DIMS)))
    got = sums.toArrow()  # at most WORD_BUCKETS + SHAPE_BUCKETS rows
    out = np.zeros((WORD_BUCKETS + SHAPE_BUCKETS, DIMS))
    if got.num_rows:
        out[got["bucket"].to_numpy()] = np.stack([got[f"c{k}"].to_numpy() for k in range(DIMS)], axis=1)
    for part in (out[:WORD_BUCKETS], out[WORD_BUCKETS:]):
        part -= part.sum(axis=0) * (np.abs(part).sum(axis=1, keepdims=True) / max(1.0, np.abs(part).sum()))
    return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def pool(texts, vectors: np.ndarray) -> np.ndarray:
    """One row of pooled features per text."""
    words, forms, doc = streams(texts)
    counts = np.bincount(doc, minlength=len(texts)).astype(np.float32)
    out = np.zeros((len(texts), 6 * DIMS + 1), np.float32)
    out[:, -1] = np.log1p(counts)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    starts = (np.cumsum(counts) - counts)[some].astype(np.int64)
    n = counts[some, None]
    for k, v in enumerate((vectors[words], vectors[WORD_BUCKETS + forms])):
        mean = np.add.reduceat(v, starts) / n
        spread = np.sqrt(np.maximum(np.add.reduceat(v * v, starts) / n - mean * mean, 0))
        step = np.abs(np.diff(v, axis=0, prepend=v[:1]))
        step[starts] = 0
        part = np.concatenate([mean, spread, np.add.reduceat(step, starts) / n], axis=1)
        out[some, 3 * DIMS * k:3 * DIMS * (k + 1)] = part
    return out


@dataclass
class Network:
    """Standardise, one hidden layer, a logit divided by the temperature."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    prior: float | None = None   # without both labels: a constant score

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.center) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return sigmoid(self.logits(x).astype(np.float64) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, ids: np.ndarray, epochs: int = 60, rate: float = 2e-3,
          decay: float = 1e-3, batch: int = 128, seed: int = 3) -> Network:
    """Adam on cross-entropy; the temperature minimises it on rows set aside."""
    if len(y) < 10 or y.min() == y.max():
        empty = np.zeros((x.shape[1], 1), np.float32)
        return Network(0.0, 1.0, empty, np.zeros(1), np.zeros(1), 0.0, prior=float(y.mean()) if len(y) else 0.5)
    draw = np.random.default_rng(seed)
    aside = holdout(ids)
    if aside.all() or y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), bool)
    tx, ty = x[~aside].astype(np.float64), y[~aside]
    center, scale = tx.mean(axis=0), tx.std(axis=0) + 1e-3
    tx = (tx - center) / scale
    params = [draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
              draw.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array(0.0)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = draw.permutation(len(ty))
        for lo in range(0, len(ty), batch):
            i = order[lo:lo + batch]
            hidden = np.maximum(tx[i] @ params[0] + params[1], 0)
            g = (sigmoid(hidden @ params[2] + params[3]) - ty[i]) / len(i)
            back = np.outer(g, params[2]) * (hidden > 0)
            grads = [tx[i].T @ back + decay * params[0], back.sum(axis=0), hidden.T @ g + decay * params[2], g.sum()]
            t += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                params[k] = params[k] - rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    net = Network(center, scale, *params[:3], float(params[3]))
    use = aside if aside.any() else np.ones(len(y), bool)
    z = net.logits(x[use].astype(np.float64))
    heats = np.exp(np.linspace(-2, 3, 101))
    p = sigmoid(z / heats[:, None]).clip(1e-9, 1 - 1e-9)
    net.temperature = float(heats[np.argmin(-(y[use] * np.log(p) + (1 - y[use]) * np.log(1 - p)).mean(axis=1))])
    return net


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors of the whole corpus, and the network."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # fixed size

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, texts, labels_ = (c.to_pylist() for c in batch.slice(at, 128).columns)
                pooled = [r.tobytes() for r in pool(texts, shared.value)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels_, pa.int32()), pa.array(pooled, pa.binary())],
                    names=["doc_id", "label", "pooled"])

    rows = labelled_sample(docs, labels, train_rows, skip=(FOLDS, HELD_OUT)).mapInArrow(
        run, "doc_id long, label int, pooled binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows["pooled"].to_pylist()), "<f4").reshape(-1, 6 * DIMS + 1)
    return vectors, train(x, rows["label"].to_numpy().astype(np.float64), rows["doc_id"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def run(batches):
        vectors, net = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = net.scores(pool(part.column(2).to_pylist(), vectors))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(
        run, SCHEMA)

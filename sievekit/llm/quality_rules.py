"""Quality rules: counters with fixed limits, and a hashed n-gram model.

One pass over Arrow batches counts words, characters, symbols, repeated lines
and repeated 3-word windows of every whole text, and scores it with a logistic
regression over hashed word unigrams, word bigrams and 4-byte n-grams. A text
is kept if no counter rule fails and the calibrated probability of good
quality reaches the threshold.

The regression is fitted on about ``train_rows`` labelled documents (a bound,
and a parameter), with a fifth of them set aside to calibrate its probability
by a logistic curve over the margin. Scoring covers every document.

Defined results: NULL text counts as empty: no words, base_failed. Without
labelled rows of both kinds the counter rules alone decide. Repeated rows are
judged alike; extra columns are ignored by ``judge`` and pass through
``keep``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import holdout, labelled_sample, sigmoid
from .words import hashes_by_text

BITS = 18
TRAIN_ROWS = 4_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, probability double")


def hashed(texts) -> list[tuple[bytes, np.ndarray]]:
    """Bytes and word hashes of each text."""
    raws = [(t or "").encode() for t in texts]
    hashes, counts = hashes_by_text(raws)
    ends = np.cumsum(counts)
    return [(raw, hashes[hi - n:hi]) for raw, hi, n in zip(raws, ends.tolist(), counts.tolist())]


def repeat_words(h: np.ndarray) -> int:
    """Words that lie in a 3-word window which occurs at least twice."""
    if len(h) < 4:
        return 0
    windows = (h[:-2] * _MIX + h[1:-1]) * _MIX + h[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    starts = np.isin(windows, again)
    inside = np.zeros(len(h), bool)
    for k in range(3):
        inside[k:k + len(starts)] |= starts
    return int(inside.sum())


def dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def counters(raw: bytes, h: np.ndarray, chars: int) -> tuple[int, int, int, int, int]:
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return len(h), chars - spaces, symbols, dup_lines(raw), repeat_words(h)


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def features(raw: bytes, h: np.ndarray) -> list[np.ndarray]:
    """Hashed indices by family: words, word pairs (a doubled word is one
    feature), 4-byte n-grams."""
    shift = np.uint64(64 - BITS)
    families = [(h * _MIX) >> shift]
    if len(h) > 1:
        pairs = (h[:-1] * _MIX + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        pairs[h[:-1] == h[1:]] = 0
        families.append(pairs >> shift)
    else:
        families.append(np.empty(0, np.uint64))
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) > 3:
        grams = (b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]) * np.uint32(0x9E3779B1)
        families.append(grams >> np.uint32(32 - BITS))
    else:
        families.append(np.empty(0, np.uint32))
    return families


@dataclass
class Model:
    """Margin = bias + mean weight of each family; probability by a logistic curve."""

    weights: np.ndarray        # 3 x 2^BITS, float32
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, families: list[np.ndarray]) -> float:
        return self.bias + sum(float(w[f].mean()) for w, f in zip(self.weights, families) if len(f))

    def probability(self, families) -> float:
        return float(sigmoid(self.slope * self.margin(families) + self.offset))


def _sparse(docs: DataFrame) -> DataFrame:
    """(doc_id, label, index, value): hashed features of the training rows."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, texts, labels = (c.to_pylist() for c in batch.slice(at, 128).columns)
                index, value = [], []
                for raw, h in hashed(texts):
                    found = features(raw, h)
                    i, v = [], []
                    for k, f in enumerate(found):
                        u, n = np.unique(f, return_counts=True)
                        i.append(u.astype(np.uint32) + np.uint32(k << BITS))
                        v.append(n.astype(np.float32) / max(1, len(f)))
                    index.append(np.concatenate(i).astype("<u4").tobytes())
                    value.append(np.concatenate(v).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(index, pa.binary()),
                     pa.array(value, pa.binary())], names=["doc_id", "label", "index", "value"])

    return docs.select("doc_id", "text", "label").mapInArrow(
        run, "doc_id long, label int, index binary, value binary")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = 60,
        rate: float = 0.5, decay: float = 1e-5) -> Model | None:
    """Logistic regression by Adam over the bounded sample; None without both kinds."""
    got = _sparse(labelled_sample(docs, labels, train_rows)).toArrow().sort_by("doc_id")
    y = got["label"].to_numpy().astype(np.float64)
    if len(y) < 10 or y.min() == y.max():
        return None
    ids = got["doc_id"].to_numpy()
    index = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in got["index"]])
    value = np.concatenate([np.frombuffer(x.as_buffer(), "<f4") for x in got["value"]])
    ends = np.cumsum([len(x.as_buffer()) // 4 for x in got["index"]])
    del got
    aside = holdout(ids)
    if aside.all() or not aside.any() or y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), bool)
    # Scale to unit spread: mean features are small numbers.
    blocks = _blocks(ends)
    dims = 3 << BITS
    scale = np.zeros(dims)
    for _, _, lo, hi, _ in blocks:
        scale += np.bincount(index[lo:hi], np.square(value[lo:hi], dtype=np.float64), dims)
    scale = np.sqrt(scale / len(y)) + 1e-3
    norm = 0.0
    for _, _, lo, hi, _ in blocks:
        value[lo:hi] /= scale[index[lo:hi]]
        norm += float(np.square(value[lo:hi], dtype=np.float64).sum())
    norm = np.sqrt(norm / len(y))
    weight = np.where(aside, 0.0, np.where(y > 0, 0.5 / y[~aside].mean(), 0.5 / (1 - y[~aside].mean())))
    w, bias = np.zeros(dims), 0.0
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    z = np.zeros(len(y))

    def margins(top, end, lo, hi, row):
        z[top:end] = np.bincount(row, value[lo:hi] * w[index[lo:hi]], end - top) + bias

    for t in range(1, epochs + 1):
        grad, total = decay * w, 0.0
        for block in blocks:
            top, end, lo, hi, row = block
            margins(*block)
            g = weight[top:end] * (sigmoid(z[top:end]) - y[top:end]) / weight.sum()
            grad += np.bincount(index[lo:hi], value[lo:hi] * g[row], dims)
            total += g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * total, 0.99 * vb + 0.01 * total ** 2
        w -= rate / norm * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        bias -= rate * 0.1 * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-8)
    for block in blocks:
        margins(*block)
    use = aside if aside.any() else np.ones(len(y), bool)
    slope, offset = calibrate(z[use], y[use])
    return Model((w / scale).astype(np.float32).reshape(3, -1), float(bias), slope, offset)


def _blocks(ends: np.ndarray, rows: int = 256):
    """(first row, end row, first entry, end entry, row of each entry) in steps."""
    starts = np.append(0, ends)
    return [(top, min(top + rows, len(ends)), int(starts[top]), int(starts[min(top + rows, len(ends))]),
             np.repeat(np.arange(min(rows, len(ends) - top), dtype=np.int16),
                       np.diff(starts[top:min(top + rows, len(ends)) + 1])))
            for top in range(0, len(ends), rows)]


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic curve over margins by Newton steps, towards smoothed labels."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    spread = z.std() or 1.0
    x = np.stack([(z - z.mean()) / spread, np.ones(len(z))], 1)
    a = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ a)
        grad = x.T @ (p - target) + 1e-3 * a
        a -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad).clip(-2, 2)
    slope = max(float(a[0] / spread), 1e-6)
    return slope, float(a[1] - a[0] * z.mean() / spread)


def _verdicts(model: Model | None, keep_at: float, texts):
    rows = []
    for t, (raw, h) in zip(texts, hashed(texts)):
        found = counters(raw, h, len(t or ""))
        failed = base_fails(found[0], found[4])
        p = model.probability(features(raw, h)) if model else None
        rows.append((*found, failed, not failed and (p is None or p >= keep_at), p))
    return rows


def judge(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, **options) -> DataFrame:
    """One row per document: counters, base_failed, kept and the probability."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))  # 3 * 2^18 weights

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                cols = list(zip(*_verdicts(model.value, keep_at, texts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:5]),
                     pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.bool_()), pa.array(cols[7], pa.float64())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept", "probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, **options) -> DataFrame:
    """The documents that the rules keep, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    kind = held.schema["_doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                mask = pa.array([r[6] for r in _verdicts(model.value, keep_at, texts)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask)], names=["_doc"])

    return held.select("_doc", F.col("_doc.text").alias("text")).mapInArrow(run, f"_doc {kind}").select("_doc.*")

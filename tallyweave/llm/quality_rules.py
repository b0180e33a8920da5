"""Quality rules: counts of words, symbols and repeats, and a calibrated n-gram classifier behind fixed thresholds.

The classifier is a logistic regression on hashed word and byte n-grams (see ``ngrams``). It learns on the driver from
a bounded sample of labelled rows; a fifth of the sample, chosen by hash, is left out to calibrate its probability.
Texts are scored where they lie, in Arrow batches, by two lookup tables of fixed size.

Defined cases: null and empty texts have no words and fail the rules. Without usable labels of both kinds the
probability is 0.5, which passes. Repeated rows are judged row by row, a null doc_id stays null, an empty table gives no rows. Very long texts are
counted whole and hashed in blocks. Columns other than doc_id and text are ignored, whatever their names; with ``carry`` all are returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, batch, blobs, bound_batches, by_size, text_bytes
from .labelled import MAX_LABELLED, Sample, sample
from .ngrams import BUCKETS, sums

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The least probability of good quality that a kept document has.
MIN_PROBABILITY = 0.3

_SYMBOLS = b"#*$%&|<>"
_NO_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))


def base_counts(body: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = body.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(joined.translate(None, _NO_SYMBOLS))
    seen, dups = set(), 0
    for line in body.split(b"\n"):
        if line.strip(WHITE):
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, dups, repeated


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


@dataclass
class Model:
    word_table: np.ndarray
    run_table: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, bodies: list[bytes]) -> np.ndarray:
        raw = sums(bodies, self.word_table, self.run_table) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -50, 50)))


def _logistic(data: Sample, rows: np.ndarray, epochs: int, rate: float, decay: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and every row's raw score, by full gradient steps with Adam."""
    size = np.diff(data.start)
    of = np.repeat(np.arange(len(data), dtype=np.int32), size)
    used = np.unique(data.ids)
    ids = np.searchsorted(used, data.ids).astype(np.int32)
    train = np.zeros(len(data))
    # both kinds weigh alike
    for kind in (0, 1):
        mine = rows[data.label[rows] == kind]
        train[mine] = 0.5 / len(mine)
    w, m, v, bias = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used)), 0.0

    # some features at a time: the driver holds no copy of all
    pieces = [slice(at, at + (1 << 19)) for at in range(0, len(ids), 1 << 19)]

    def raw() -> np.ndarray:
        return sum((np.bincount(of[p], data.values[p] * w[ids[p]], len(data)) for p in pieces), np.zeros(len(data))) + bias

    for step in range(1, epochs + 1):
        error = (1 / (1 + np.exp(-np.clip(raw(), -50, 50))) - data.label) * train
        g = sum((np.bincount(ids[p], data.values[p] * error[of[p]], len(used)) for p in pieces), decay * w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        bias -= rate * error.sum()
    full = np.zeros(2 * BUCKETS, np.float32)
    full[used] = w
    return full, bias, raw()


def _platt(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated probability: Newton steps, halved until they help, on smoothed targets."""
    good = label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (len(label) - good + 2))
    scale = max(np.abs(raw).max(), 1e-9)
    x = np.stack([raw / scale, np.ones(len(raw))], axis=1)

    def loss(a: np.ndarray) -> float:
        z = x @ a
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-3 * (a @ a))

    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (p - target) + 2e-3 * a)
        while loss(a - step) > loss(a) and np.abs(step).max() > 1e-9:
            step /= 2
        a = a - step
    return max(float(a[0]) / scale, 1e-3), float(a[1])


def fit(data: Sample, epochs: int = 60, rate: float = 0.05, decay: float = 1e-6) -> Model | None:
    """None if the sample lacks labels of one kind."""
    calibrates = np.array([hash_ % 5 == 0 for hash_ in (data.doc_id * 2654435761 % (1 << 32) >> 7)], bool)
    rows = np.flatnonzero(~calibrates)
    if len(set(data.label[rows])) < 2:
        return None
    table, bias, raw = _logistic(data, rows, epochs, rate, decay)
    model = Model(table[:BUCKETS], table[BUCKETS:], bias)
    if len(set(data.label[calibrates])) == 2:
        model.slope, model.offset = _platt(raw[calibrates], data.label[calibrates])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model | None:
    return fit(sample(docs, labels, most=most))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model | None, min_probability: float = MIN_PROBABILITY, carry: bool = False) -> DataFrame:
    """doc_id, the five counts, base_failed, probability and kept; with ``carry`` instead all columns of the documents and _tw_kept."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if carry:
        rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
        ddl = ", ".join([*rest, "_tw_kept boolean"])
        rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], text_bytes().alias("_tw_body"))
    else:
        ddl = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, probability double, kept boolean"
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_tw_body"))
    own = rows.columns[:-1]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for part in by_size(b, len(own), 4 << 20):
                bodies = blobs(part.column(len(own)))
                counts = np.array([base_counts(x) for x in bodies], np.int64).reshape(-1, 5)
                failed = np.array([fails(n, r) for n, r in counts[:, [0, 4]].tolist()], bool)
                p = np.full(len(bodies), 0.5) if model is None else model.probability(bodies)
                kept = ~failed & (p >= min_probability)
                if carry:
                    out = pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(own))), pa.array(kept)], names=[*own, "_tw_kept"])
                    yield out.filter(pa.array(kept))
                else:
                    yield batch(schema, part.column(0), *counts.T, failed, p, kept)

    return rows.mapInArrow(run, ddl)

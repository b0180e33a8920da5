"""Quality classifier with learned subword embeddings.

Words, word pairs and byte runs are hashed (see ``ngrams``); each bucket has a learned vector, a document is the mean
of its features' vectors, and a softmax over two classes judges it. Vectors and classes are trained together by numpy
stochastic gradient descent on a bounded sample of labelled rows. To score, each bucket's vector is first multiplied
with the difference of the two class vectors: as the mean is linear, one number a bucket gives the same result.

Defined cases: null and empty texts get the score of the biases alone. Without usable labels of both kinds every score is 0.5. Repeated rows are scored
row by row, a null doc_id counts as the empty text for held_out and stays null, an empty table gives no rows. Very long texts are hashed in blocks, whole.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blobs, bound_batches, by_size, text_bytes
from .labelled import MAX_LABELLED, Sample, remainder, sample
from .ngrams import BUCKETS, sums

DIMENSIONS = 8
HELD_OUT_OF = 5
THRESHOLD = 0.3


@dataclass
class Embeddings:
    vectors: np.ndarray  # a row for each bucket of word features, then of byte runs
    classes: np.ndarray  # a row for each of the two classes
    biases: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, float]:
        one = (self.vectors @ (self.classes[1] - self.classes[0])).astype(np.float32)
        return one[:BUCKETS], one[BUCKETS:], float(self.biases[1] - self.biases[0])


def fit(data: Sample, dimensions: int = DIMENSIONS, epochs: int = 8, rate: float = 0.2, seed: int = 7) -> Embeddings | None:
    """None if the sample lacks labels of one kind."""
    if len(set(data.label)) < 2:
        return None
    rng = np.random.default_rng(seed)
    # a feature that no labelled row has says nothing
    vectors = np.zeros((2 * BUCKETS, dimensions), np.float32)
    classes, biases = rng.normal(0, 0.5, (2, dimensions)).astype(np.float32), np.zeros(2, np.float32)
    share = np.bincount(data.label.astype(int), minlength=2) / len(data)
    weight = np.minimum(0.5 / share, 3)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) / 4
        for i in rng.permutation(len(data)):
            ids, values = data.row(i)
            v = values.astype(np.float32)
            mean = v @ vectors[ids]
            logits = classes @ mean + biases
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(data.label[i])] -= 1
            p *= np.float32(step * weight[int(data.label[i])])
            back = np.clip(p @ classes, -1, 1)
            classes -= np.clip(np.outer(p, mean), -1, 1)
            biases -= p
            vectors[ids] -= np.outer(v / 8, back)
    return Embeddings(vectors, classes, biases)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Embeddings | None:
    """Learns only from rows whose crc32(doc_id as text) mod 5 isn't 0."""
    return fit(sample(docs, labels, most=most, learn=remainder(F.col("doc_id"), HELD_OUT_OF) != 0))


def score(docs: DataFrame, model: Embeddings | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else model.tables())
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for b in batches:
            for part in by_size(b, 2, 4 << 20):
                p = np.full(part.num_rows, 0.5)
                if tables is not None:
                    p = 1 / (1 + np.exp(-np.clip(sums(blobs(part.column(2)), tables[0], tables[1]) + tables[2], -50, 50)))
                yield batch(schema, part.column(0), part.column(1), p, (p >= threshold).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), HELD_OUT_OF) == 0).alias("held_out"), text_bytes().alias("body"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

"""Labelled rows for classifiers: a bounded sample, brought to the driver as hashed features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, blobs, bound_batches, by_size, materialize, release, text_bytes
from .ngrams import sparse

#: Bounds on the labelled documents that a classifier learns from, and on their features together (8 bytes each). They are
#: taken whole, in the order of a hash of their id, as long as both bounds hold.
MAX_LABELLED, MAX_FEATURES = 2500, 12_000_000


@dataclass
class Sample:
    """Rows of features in one long list: row i has ids[start[i]:start[i + 1]] and values likewise."""

    doc_id: np.ndarray
    label: np.ndarray
    start: np.ndarray
    ids: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.label)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[self.start[i] : self.start[i + 1]], self.values[self.start[i] : self.start[i + 1]]


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def sample(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MAX_LABELLED, learn: Column | None = None) -> Sample:
    """At most ``most`` labelled documents, whole texts; ``learn``: which rows of the labels may be used.

    Labels that are null, or contradict each other for a document, aren't used; nor are rows that repeat a doc_id after the first.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    marked = marked if learn is None else marked.where(learn)
    marked = marked.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("_high")).where("label = _high")
    chosen = marked.select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 2, 4 << 20):
                found = [sparse(body) for body in blobs(part.column(2))]
                yield batch(schema, part.column(0), part.column(1), [i.astype(np.int32) for i, _ in found], [v.astype(np.float32) for _, v in found])

    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    # at most ``most`` ids: the bound of the broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "body").mapInArrow(run, "doc_id long, label int, ids array<int>, counts array<float>")
    made = materialize(rows, "labelled")
    # at most ``most`` ids and a number each
    upto = made.groupBy("doc_id").agg(F.max(F.size("ids")).cast("long").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))
    t = made.join(F.broadcast(upto.where(F.col("upto") <= MAX_FEATURES).select("doc_id")), "doc_id").select("doc_id", "label", "ids", "counts").toArrow().combine_chunks()
    release(made)
    order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
    order = order[np.unique(t.column("doc_id").to_numpy()[order], return_index=True)[1]] if len(order) else order
    t = t.take(order)
    ids, values = t.column("ids").combine_chunks(), t.column("counts").combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids, values = pa.concat_arrays(ids.chunks), pa.concat_arrays(values.chunks)
    sizes = np.array([len(x) for x in ids], np.int64)
    return Sample(t.column("doc_id").to_numpy(), t.column("label").to_numpy().astype(np.float64), np.concatenate(([0], np.cumsum(sizes))), ids.flatten().to_numpy(), values.flatten().to_numpy())

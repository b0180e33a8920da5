"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; the same set that ``bytes.split`` and ``bytes.strip`` use.
WHITE = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``, removed when the driver ends.

    Only where that setting is absent and the master is this process (tests) a temporary folder stands in for it; on a cluster
    executors wouldn't see each other's, so there it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="tallyweave-")
        _ROOTS[app] = f"{base.rstrip('/')}/tallyweave-{app}"
        atexit.register(_drop_quietly, spark, _ROOTS[app])
    return _ROOTS[app]


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may be gone already at exit
        pass


def drop(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyweave_path = path
    return out


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are run within give back their shuffle files as soon as they end; for tables that are written once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(df: DataFrame | None) -> None:
    """Delete a table made by ``materialize`` that no later step reads."""
    path = getattr(df, "_tallyweave_path", None)
    if path:
        drop(df.sparkSession, path)


#: Most bytes of an Arrow batch on its way to a Python worker; texts are long, so rows alone don't bound it.
BATCH_BYTES = 8 << 20


#: Where whole tables of texts are read and written again and again: the same, and rows that a Parquet reader decodes at once. It holds a
#: column's values of so many rows in one array, which grows by doubling: 4096 rows, Spark's own bound, are some 30 MB of texts, twice a task.
SMALL_BATCH_BYTES, READ_ROWS = 2 << 20, 256


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lower the session's bound on Arrow batches to ``most`` bytes, if it isn't lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= most):
        spark.conf.set(key, str(most))


def bound_memory(spark: SparkSession) -> None:
    """Lower the session's bounds on Arrow batches and on rows that a Parquet reader decodes at once, if they aren't lower already."""
    bound_batches(spark, SMALL_BATCH_BYTES)
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))


def text_bytes(name: str = "text") -> Column:
    """The whole text as UTF-8; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def doc_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id`` and the text as bytes, whatever other columns the table has."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"), *more)


def blobs(array: pa.Array) -> list[bytes]:
    return array.to_pylist()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def by_size(b: pa.RecordBatch, column: int, most: int):
    """Slices of a batch whose values in a binary column hold about ``most`` bytes; no empty slices."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros(0)
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, end - at)
        at = end


def as_uint64(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).view(np.uint64)


#: A key is hot if it has at least so many rows, and more than one in so many of all rows: there can't be more hot keys than HOT.
HOT_ROWS, HOT = 1000, 10_000


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, wherever it stands: a key that a third of all rows share weighs on no task.

    ``right`` has one row a key, with the number of rows of left that have it (or more) in ``n``; ``total`` is at least the sum of n.
    Hot keys are fewer than HOT by arithmetic, so they are broadcast; the others are shuffled. ``right`` is written once, so that plans stay small.
    """
    if total < HOT_ROWS:
        return left.join(right, key)
    right = materialize(right, "keys")
    is_hot = (F.col(n) >= HOT_ROWS) & (F.col(n).cast("double") * HOT > total)
    hot = right.where(is_hot)
    if hot.isEmpty():
        return left.join(right, key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(right.where(~is_hot), key))

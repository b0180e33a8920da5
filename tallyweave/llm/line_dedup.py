"""Line dedup over all documents.

Hashes of long lines are dealt by range of (hash, document) and sorted within each task by hash, then document
from the largest down. A task streams its rows: the first document of a hash keeps the line, and once the hash has
been seen in ``min_docs`` documents all other documents lose it. Until then the rows of a hash are held, afterwards they are written as
they come, so memory doesn't depend on how common a line is. A line that very many documents hold is cut over many tasks by the range;
the first and the last hash of each task are counted in part and the counts, two rows a task, are added up over all tasks. Documents
get their decisions as a compressed bitmap of the lines that stay; texts aren't shuffled to decide. To be cut, texts are brought to
their bitmaps by one shuffle without a sort.

Defined cases: null and empty texts are one empty line. A line repeated in a document counts once, and all its
places stay or go together. Rows that share a doc_id count as one document but have bitmaps of their own. A null
doc_id is a document below all others. Line keys are compared by 128-bit hashes. Very long texts and lines are read whole. An empty table gives
an empty result. Columns other than doc_id and text are ignored, whatever their names (``dedup_texts`` returns them all).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, batch, blobs, bound_batches, by_size, materialize, text_bytes

MIN_CHARS, MIN_DOCS = 40, 5
_NO_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without white space at its ends, A-Z lower-cased; none if it's shorter than ``min_chars`` code points."""
    key = line.strip(WHITE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.lower()


def _keyed(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), text_bytes().alias("body")).withColumn("same", F.xxhash64("body"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each document and distinct long line: h1, h2, doc, same (hash of the text), n_lines, places (int32s)."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("same", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for part in by_size(b, 1, 8 << 20):
                hashes, docs_, sames, sizes, places = [], [], [], [], []
                for doc, body, same in zip(part.column(0).to_pylist(), blobs(part.column(1)), part.column(2).to_pylist()):
                    lines, at = body.split(b"\n"), {}
                    for i, line in enumerate(lines):
                        if len(line) >= min_chars and (key := line_key(line, min_chars)) is not None:
                            h = digest(key)
                            if h in at:
                                at[h].append(i)
                            else:
                                at[h] = [i]
                    hashes += at
                    docs_ += [doc] * len(at)
                    sames += [same] * len(at)
                    sizes += [len(lines)] * len(at)
                    places += [np.array(v, "<i4").tobytes() for v in at.values()]
                pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                yield batch(schema, pairs[:, 0], pairs[:, 1], docs_, sames, sizes, places)

    return _keyed(docs).mapInArrow(run, "h1 long, h2 long, doc long, same long, n_lines int, places binary")


#: What a row of the streamed table says: a line that goes, a line to be decided by counts over all tasks, or such a count.
GOES, OPEN, COUNT = 0, 1, 2


def drops(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, same, n_lines, places: the lines that documents lose."""
    names = ["h1", "h2", "doc", "same", "n_lines", "places"]
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("same", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary()), ("kind", pa.int8())])
    rows_schema = pa.schema(list(schema)[:6])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the last hash seen only rows of fewer than ``min_docs`` documents are held; the first hash of a task, and the last, are left open."""
        held = pa.Table.from_batches([], schema=rows_schema)
        # the hash whose rows are written as they come, if there is one; its first document, its last, how many, and whether it's the task's first hash
        at, holder, last, n_docs, is_first, begun = None, 0, 0, 0, False, False

        def out(t: pa.Table, kind: int) -> Iterator[pa.RecordBatch]:
            if t.num_rows:
                yield from t.append_column("kind", pa.array(np.full(t.num_rows, kind, np.int8))).cast(schema).to_batches()

        def count(h1: int, h2: int, n: int, first: int) -> pa.RecordBatch:
            return batch(schema, [h1], [h2], [first], [n], [0], [b""], [COUNT])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.concat_tables([held, pa.Table.from_batches([b]).cast(rows_schema)]).combine_chunks()
            held = t.slice(0, 0)
            h1, h2, doc = (t.column(i).to_numpy() for i in range(3))
            if at is not None:
                more = int(np.argmin(np.concatenate(((h1 == at[0]) & (h2 == at[1]), [False]))))
                if more:
                    own = doc[:more]
                    n_docs += int((np.concatenate(([last], own[:-1])) != own).sum())
                    last = int(own[-1])
                    yield from out(t.slice(0, more), OPEN if is_first else GOES)
                if more == t.num_rows:
                    continue
                if is_first:
                    yield count(*at, n_docs, holder)
                at, t, h1, h2, doc = None, t.slice(more), h1[more:], h2[more:], doc[more:]
            new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            fresh = new | np.concatenate(([True], doc[1:] != doc[:-1]))
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            each = np.bincount(group, weights=fresh).astype(np.int64)
            of = np.cumsum(fresh)
            other = of != of[start][group]  # not of the document that holds the line on
            whole = np.arange(len(start)) < len(start) - 1
            if not begun:  # the task's first hash may have begun in another
                end = int(start[1]) if len(start) > 1 else len(h1)
                yield from out(t.slice(0, end), OPEN)
                whole[0], begun = False, True
                if len(start) > 1:
                    yield count(int(h1[0]), int(h2[0]), int(each[0]), int(doc[0]))
                else:
                    at, holder, last, n_docs, is_first = (int(h1[0]), int(h2[0])), int(doc[0]), int(doc[-1]), int(each[0]), True
                    continue
            yield from out(t.filter(pa.array(whole[group] & (each[group] >= min_docs) & other)), GOES)
            tail = int(start[-1])
            if each[-1] >= min_docs:
                at, holder, last, n_docs, is_first = (int(h1[-1]), int(h2[-1])), int(doc[tail]), int(doc[-1]), int(each[-1]), False
                yield from out(t.slice(tail).filter(pa.array(other[tail:])), GOES)
            else:
                held = t.slice(tail)
        if held.num_rows:
            own = held.column(2).to_numpy()
            yield from out(held, OPEN)
            yield count(held.column(0)[0].as_py(), held.column(1)[0].as_py(), 1 + int((own[1:] != own[:-1]).sum()), int(own[0]))
        elif at is not None:
            yield count(*at, n_docs, holder)

    # hashes dealt by range, documents from the largest down within each
    dealt = lines.withColumn("down", F.bitwise_not("doc")).repartitionByRange("h1", "h2", "down").sortWithinPartitions("h1", "h2", "down").select(names)
    streamed = materialize(dealt.mapInArrow(run, "h1 long, h2 long, doc long, same long, n_lines int, places binary, kind tinyint"), "lines")
    counted = streamed.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("same").alias("n_docs"), F.max("doc").alias("holder"))
    # at most two hashes a task are counted: the bound of the broadcast
    more = streamed.where(F.col("kind") == OPEN).join(F.broadcast(counted.where(F.col("n_docs") >= min_docs)), ["h1", "h2"]).where("doc <> holder")
    return streamed.where(F.col("kind") == GOES).select(names[2:]).union(more.select(names[2:]))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, same, n_lines, n_dropped and keep for each document that loses lines.

    ``keep`` is a zlib-compressed bitmap, lowest bit first, with a 1 for each line that stays.
    """
    schema = pa.schema([("doc", pa.int64()), ("same", pa.int64()), ("n_lines", pa.int32()), ("n_dropped", pa.int32()), ("keep", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_dropped, keep = [], []
            for n, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                stays = np.ones(n, bool)
                stays[np.frombuffer(b"".join(places), "<i4")] = False
                n_dropped.append(n - int(stays.sum()))
                keep.append(zlib.compress(np.packbits(stays, bitorder="little").tobytes(), 1))
            yield batch(schema, b.column(0), b.column(1), b.column(2), n_dropped, keep)

    lost = drops(line_hashes(docs, min_chars), min_docs)
    grouped = lost.groupBy("doc", "same", "n_lines").agg(F.collect_list("places").alias("places"))
    return grouped.mapInArrow(run, "doc long, same long, n_lines int, n_dropped int, keep binary")


def keep_lines(body: bytes, keep: bytes) -> bytes:
    lines = body.split(b"\n")
    stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return b"\n".join([line for line, s in zip(lines, stays.tolist()) if s])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, *columns: str) -> DataFrame:
    """Each row of the documents with its bitmap, as _tw_n_dropped and _tw_keep; null where all lines stay."""
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_tw_doc"), F.xxhash64(text_bytes()).alias("_tw_same"))
    b = bitmaps.select(F.col("doc").alias("_tw_doc"), F.col("same").alias("_tw_same"), F.col("n_dropped").alias("_tw_n_dropped"), F.col("keep").alias("_tw_keep"))
    # bitmaps are the small side of each partition: texts pass by them unsorted
    return keyed.join(b.hint("shuffle_hash"), ["_tw_doc", "_tw_same"], "left").drop("_tw_doc", "_tw_same")


def dedup_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and keep (the bitmap, null if all lines stay)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("keep", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 1, 8 << 20):
                n_lines, sha = [], []
                for body, keep in zip(blobs(part.column(1)), blobs(part.column(3))):
                    n_lines.append(body.count(b"\n") + 1)
                    sha.append(hashlib.sha256(body if keep is None else keep_lines(body, keep)).hexdigest())
                yield batch(schema, part.column(0), n_lines, part.column(2).cast(pa.int64()), sha, part.column(3))

    bound_batches(docs.sparkSession)
    rows = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), "doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long"), text_bytes().alias("body"), F.coalesce("_tw_n_dropped", F.lit(0)).alias("n"), "_tw_keep")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep binary")


def dedup_texts(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with only the lines that stay; n_chars, if there, is the new length. All rows stay."""
    @F.pandas_udf("string")
    def cut(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([t if k is None else keep_lines((t or "").encode(), k).decode() for t, k in zip(text, keep)], dtype=object)

    bound_batches(docs.sparkSession)
    rows = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), *docs.columns)
    rows = rows.withColumn("text", cut("text", "_tw_keep"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_tw_keep").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])

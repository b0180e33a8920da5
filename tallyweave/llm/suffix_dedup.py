"""Suffix-array dedup: bytes that stand in a string of ``length`` bytes which a document with a smaller doc_id also holds.

The suffixes of a corpus don't fit one array, so strings are dealt by a gram that equal strings have in common: the one with the least hash of the
``length - GRAM + 1`` grams of a string (minimum substring partitioning). A text falls into pieces, runs of strings with one such gram. In four steps:

1. Grams with their documents are dealt by range and sorted; those of a single document leave. Borders of Arrow batches keep a few too many, which costs nothing but time.
2. Texts meet their grams and give the pieces around them, which are dealt by range of (gram, document).
3. A task fills chunks of about CHUNK bytes with different pieces and builds a suffix array of each by two-stage sorting: suffixes that are smaller than their
   successor are sorted directly by their first bytes, all others follow from them by scans of the buckets of first bytes; neighbours in the array whose
   common prefix reaches ``length`` are one string, and its least document keeps it. Only suffixes where a string starts, and those they
   follow from, are ordered.
4. A gram that more than one chunk or task holds is open: of each of its strings only the least document of a chunk isn't decided; these meet by
   a hash of the string (128 bits), a row a chunk at most.

Texts that are equal to one with a smaller doc_id lose all their bytes and give no pieces. Documents get the spans they lose; texts meet them by one more shuffle, unless the spans are small enough to be broadcast. A gram or passage that a third of all documents
hold is cut over tasks by the range, and equal pieces are sorted once a chunk.

Defined cases: null and empty texts have no bytes. Texts shorter than ``length`` lose none. A null doc_id is smaller than all others; rows that share a
doc_id count as one document and don't take bytes from each other. Repeats within a document stay. Texts of any length are read whole. An empty table gives an empty
result. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, blobs, bound_batches, by_size, freed_shuffles, join_counted, materialize, release, text_bytes

LENGTH, GRAM, CHUNK = 50, 16, 2 << 20
_NO_ID = -(1 << 63)
_PAD = bytes(64)
GOES, OPEN = 0, 1


def _words(buffer: bytes | np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each position on as a number; the last 7 positions have none."""
    return np.ndarray((len(buffer) - 7,), f"{order}u8", buffer, 0, (1,))


def pieces(bodies: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gram, text, start, n: for each run of n strings with one least gram its hash, the number of the text and the first string's place in it."""
    sizes = np.array([len(x) for x in bodies], np.int64)
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    words = _words(b"".join(bodies) + _PAD, "<")
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    wide = length - GRAM + 1
    done = 1
    while done < wide:  # the least of ``done`` hashes from each place on
        step = min(done, wide - done)
        np.minimum(h[:-step], h[step:], out=h[:-step])
        done += step
    whole = sizes >= length
    edge = np.zeros(n + 1, np.int8)
    edge[starts[whole]] = 1
    edge[(starts + sizes - length + 1)[whole]] -= 1
    is_string = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    begins = is_string.copy()
    begins[1:] &= h[1:] != h[:-1]
    begins[starts[whole]] = True
    at = np.flatnonzero(begins)
    text = np.searchsorted(starts, at, "right") - 1
    until = np.minimum(np.append(at[1:], n), (starts + sizes - length + 1)[text])
    return h[at].view(np.int64), text, at - starts[text], until - at


def directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes: by 8 bytes at a time, only those that are still equal."""
    words = _words(text, ">")
    key = words[at].astype(np.uint64)
    order = np.argsort(key)
    at, key = at[order], key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))[: len(at)]
    for step in range(8, depth, 8):
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(tied):
            break
        group = np.cumsum(fresh)[tied]
        key = words[at[tied] + step].astype(np.uint64)
        order = np.lexsort((key, group))
        at[tied], key = at[tied][order], key[order]
        fresh[tied[1:]] |= key[1:] != key[:-1]
    return at


def two_stage(buffer: bytes, starts: np.ndarray, counts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes at ``starts``, and the ``counts`` - 1 after each, in the order of at least their first ``depth`` bytes."""
    n = len(buffer)
    padded = np.frombuffer(buffer + _PAD, np.uint8)
    text = padded[:n]
    symbols = np.append(text.astype(np.int16), -1)  # the end is below all bytes
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # of runs of equal bytes
    runs = np.diff(ends, prepend=-1)
    rises = symbols[ends] < symbols[ends + 1]
    smaller = np.repeat(rises, runs)  # than its successor: all of a run alike
    left = np.arange(n) - np.repeat(ends - runs + 1, runs)  # how many equal bytes stand before
    # beyond the last suffix asked for, those that it follows from: up to the next that is sorted directly
    following = np.minimum.accumulate(np.where(smaller, np.arange(n), n)[::-1])[::-1]
    last = starts + counts - 1
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(following[last], n - 1) + 1, -1)
    needed = np.cumsum(edge[:n]) > 0
    sorted_ = directly(padded, np.flatnonzero(needed & smaller), depth)
    bound = np.searchsorted(text[sorted_], np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]

    def scan(bucket: np.ndarray) -> None:
        """Suffixes of larger first bytes follow in the order of their successors."""
        before = bucket[bucket > 0] - 1
        before = before[needed[before]]
        before = before[symbols[before] > symbols[before + 1]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))[: len(first)]
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(first)]):
            larger[first[a]].append(before[a:b])

    out = []
    scan(np.array([n]))
    for byte in range(256):
        bucket = sorted_[bound[byte] : bound[byte + 1]]
        if larger[byte]:
            # a suffix that begins with k equal bytes more comes after all that begin with fewer, in the same order
            base = np.concatenate(larger[byte])
            more = left[base] + 1
            which = np.repeat(np.arange(len(base)), more)
            k = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more)
            order = np.argsort(k, kind="stable")
            falling = base[which[order]] - k[order]
            bucket = np.concatenate((falling[needed[falling]], bucket))
        if len(bucket):
            out.append(bucket)
            scan(bucket)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts, -1)
    return order[(np.cumsum(edge[:n]) > 0)[order]]


def least_documents(bodies: list[bytes], counts: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each of the ``counts`` strings of each piece, one after the other, the least document of any piece that holds it."""
    buffer = b"".join(bodies)
    sizes = np.array([len(x) for x in bodies], np.int64)
    starts = np.cumsum(sizes) - sizes
    order = two_stage(buffer, starts, counts, length)
    words = _words(buffer + _PAD, "<")
    # neighbours whose common prefix reaches ``length``
    alike = np.arange(1, len(order))
    for step in (*range(0, length - 7, 8), length - 8):
        alike = alike[words[order[alike] + step] == words[order[alike - 1] + step]]
    fresh = np.ones(len(order), bool)
    fresh[alike] = False
    piece = np.searchsorted(starts, order, "right") - 1
    least = np.minimum.reduceat(docs[piece], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    first = np.cumsum(counts) - counts
    out = np.empty(len(order), np.int64)
    out[first[piece] + order - starts[piece]] = least
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, same (a hash of the text), salt (a little of it, so that rows of one doc_id spread), body."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    rows = rows.withColumn("same", F.xxhash64("body"))
    return rows.withColumn("salt", (F.col("same") % 1024).cast("int"))


def shared_grams(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, salt, gram: grams of more than one document (and a few others)."""
    schema = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("salt", pa.int32())])
    out_schema = pa.schema([("doc", pa.int64()), ("salt", pa.int32()), ("gram", pa.int64())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 2, 1 << 20):
                gram, text, _start, _n = pieces(blobs(part.column(2)), length)
                yield batch(schema, gram, part.column(0).to_numpy()[text], part.column(1).to_numpy()[text])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            gram, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            end = np.append(at[1:], len(gram))
            stays = doc[at] != doc[end - 1]
            stays[[0, -1]] = True  # may go on in another batch or task
            rows = b.filter(pa.array(np.repeat(stays, end - at)))
            yield batch(out_schema, rows.column(1), rows.column(2), rows.column(0))

    dealt = _keyed(docs).select("doc", "salt", "body").where(F.length("body") >= length).mapInArrow(grams, "gram long, doc long, salt int")
    return dealt.repartitionByRange("gram", "doc").sortWithinPartitions("gram", "doc").mapInArrow(several, "doc long, salt int, gram long")


def copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, salt, same, n: texts that a smaller doc_id also has, whole; texts of ``length`` bytes and more only."""
    rows = _keyed(docs).where(F.length("body") >= length).select("doc", "salt", "same", F.length("body").alias("n"), F.md5("body").alias("md5"))
    rows = materialize(rows, "texts")
    least = rows.groupBy("md5").agg(F.count("*").alias("n_rows"), F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    found = join_counted(rows, least, "md5", rows.count(), "n_rows").where("doc > least").select("doc", "salt", "same", "n")
    found = materialize(found, "copies")
    release(rows)
    return found


def shared_pieces(docs: DataFrame, shared: DataFrame, whole: DataFrame, length: int = LENGTH) -> DataFrame:
    """gram, doc, same, start, body: the pieces of texts around their shared grams, of all texts but the ``copies`` in ``whole``."""
    schema = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("same", pa.int64()), ("start", pa.int32()), ("body", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 2, 1 << 20):
                bodies, lists = blobs(part.column(2)), part.column(3)
                gram, text, start, n = pieces(bodies, length)
                bound = np.searchsorted(text, np.arange(len(bodies) + 1))
                stays = np.zeros(len(gram), bool)
                for i in range(len(bodies)):
                    stays[bound[i] : bound[i + 1]] = np.isin(gram[bound[i] : bound[i + 1]], lists[i].values.to_numpy())
                gram, text, start, n = gram[stays], text[stays], start[stays], n[stays]
                cuts = [bodies[t][s : s + k] for t, s, k in zip(text.tolist(), start.tolist(), (n + length - 1).tolist())]
                yield batch(schema, gram, part.column(0).to_numpy()[text], part.column(1).to_numpy()[text], start, cuts)

    lists = shared.groupBy("doc", "salt").agg(F.collect_list("gram").alias("grams"))
    lists = lists.join(whole.groupBy("doc", "salt").agg(F.collect_set("same").alias("copies")), ["doc", "salt"], "left")
    rows = _keyed(docs).where(F.length("body") >= length).join(lists, ["doc", "salt"])
    rows = rows.where(~F.coalesce(F.array_contains("copies", F.col("same")), F.lit(False))).select("doc", "same", "body", "grams")
    return rows.mapInArrow(cut, "gram long, doc long, same long, start int, body binary")


def _chunk(rows: pa.Table, is_open: set[int], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    gram, doc, same, start = (rows.column(i).to_numpy() for i in range(4))
    bodies = rows.column(4).to_pylist()
    numbers: dict[tuple[int, bytes], int] = {}
    piece = np.array([numbers.setdefault(k, len(numbers)) for k in zip(gram.tolist(), bodies)], np.int64)
    distinct = [body for _gram, body in numbers]
    first = np.unique(piece, return_index=True)[1]
    docs = doc[first]  # rows of a gram are sorted by document: the first is the least
    counts = np.array([len(x) - length + 1 for x in distinct], np.int64)
    least = least_documents(distinct, counts, docs, length)
    at = np.cumsum(counts) - counts
    own = least == np.repeat(docs, counts)
    later = doc > docs[piece]
    out_doc, out_same, out_start, out_size = [doc[later]], [same[later]], [start[later]], [(counts + length - 1)[piece[later]]]
    # rows of a piece's least document lose the strings that another piece gives to a smaller one
    lost = np.flatnonzero(~later & np.add.reduceat(~own, at).astype(bool)[piece])
    for i in lost.tolist():
        p = piece[i]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ~own[at[p] : at[p] + counts[p]], [False])).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        out_doc.append(np.full(len(a), doc[i]))
        out_same.append(np.full(len(a), same[i]))
        out_start.append(start[i] + a)
        out_size.append(b - a + length - 1)
    d, s, p, z = (np.concatenate(x) for x in (out_doc, out_same, out_start, out_size))
    nothing = np.zeros(len(d), np.int64)
    yield batch(schema, np.full(len(d), GOES, np.int8), nothing, nothing, d, s, p, z)
    if is_open:
        hashes, ds, ss, ps = [], [], [], []
        for i in np.flatnonzero(~later & np.isin(gram, list(is_open))).tolist():
            p, body = piece[i], distinct[piece[i]]
            for k in np.flatnonzero(own[at[p] : at[p] + counts[p]]).tolist():
                hashes.append(xxhash.xxh3_128_digest(body[k : k + length]))
                ds.append(doc[i])
                ss.append(same[i])
                ps.append(start[i] + k)
        h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        yield batch(schema, np.full(len(ds), OPEN, np.int8), h[:, 0], h[:, 1], np.array(ds, np.int64), np.array(ss, np.int64), np.array(ps, np.int32), np.full(len(ds), length, np.int32))


def spans(found: DataFrame, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """doc, same, start, size: the bytes that texts lose, in spans that may overlap."""
    schema = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("same", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, going_on = [], 0, None  # rows of a chunk, their bytes, and the gram that a chunk or task before may have
        is_first = True

        def full(rows: pa.Table, is_last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """The results of a chunk, then the rows left over for the next."""
            nonlocal going_on
            gram = rows.column(0).to_numpy()
            changes = np.flatnonzero(gram[1:] != gram[:-1])
            tail = int(changes[-1]) + 1 if len(changes) else 0
            opened = {going_on} if going_on is not None else set()
            rest = rows.slice(len(gram))
            going_on = None
            if is_last:
                opened.add(int(gram[-1]))
            elif tail and len(gram) - tail < len(gram) // 2:
                rows, rest = rows.slice(0, tail), rows.slice(tail)
            else:
                going_on = int(gram[-1])
                opened.add(going_on)
            yield from _chunk(rows, opened, length, schema)
            yield rest

        for b in batches:
            if not b.num_rows:
                continue
            if is_first:
                going_on, is_first = b.column(0)[0].as_py(), False
            for part in by_size(b, 4, chunk):
                held.append(pa.Table.from_batches([part]))
                size += part.column(4).nbytes
                if size >= chunk:
                    *done, rest = full(pa.concat_tables(held).combine_chunks(), False)
                    yield from done
                    held, size = [rest] if rest.num_rows else [], rest.column(4).nbytes
        if held:
            *done, _rest = full(pa.concat_tables(held).combine_chunks(), True)
            yield from done

    dealt = found.repartitionByRange("gram", "doc").sortWithinPartitions("gram", "doc")
    made = dealt.mapInArrow(run, "kind tinyint, h1 long, h2 long, doc long, same long, start int, size int")
    with freed_shuffles(found.sparkSession):
        made = materialize(made, "spans")
    # a string has a row for each chunk that its gram is spread over
    least = F.min("doc").over(Window.partitionBy("h1", "h2"))
    open_ = made.where(F.col("kind") == OPEN).withColumn("least", least).where("doc > least")
    names = ["doc", "same", "start", "size"]
    return made.where(F.col("kind") == GOES).select(names).unionByName(open_.select(names))


def dedup(docs: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay; null unless asked for) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 1, 8 << 20):
                kept, n_spans = [], []
                bodies = blobs(part.column(1))
                for body, lost in zip(bodies, part.column(2)):
                    if not lost.is_valid:
                        kept.append(body)
                        n_spans.append(0)
                        continue
                    start, size = np.divmod(lost.values.to_numpy(), 1 << 32)
                    edge = np.zeros(len(body) + 1, np.int32)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + size, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes())
                sizes = [len(x) for x in bodies]
                yield batch(
                    schema, part.column(0), sizes, [n - len(k) for n, k in zip(sizes, kept)], n_spans,
                    [hashlib.sha256(k).hexdigest() for k in kept], kept if keep_text else pa.nulls(len(kept), pa.binary()),
                )

    with freed_shuffles(docs.sparkSession):
        shared = materialize(shared_grams(docs, length), "grams")
        whole = copies(docs, length)
        found = materialize(shared_pieces(docs, shared, whole, length), "pieces")
        release(shared)
    lost = spans(found, length).unionByName(whole.select("doc", "same", F.lit(0).alias("start"), F.col("n").alias("size")))
    release(found)
    lists = lost.groupBy("doc", "same").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + F.col("size")).alias("lost"))
    rows = _keyed(docs).select("doc_id", "doc", "same", "body").join(lists, ["doc", "same"], "left").select("doc_id", "body", "lost")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

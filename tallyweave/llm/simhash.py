"""SimHash near-duplicates, found by pigeonring filtering.

The 64 bits lie in a ring of five segments. If two fingerprints differ in at most 2 bits, then from some
segment on every chain of 1, 2, ... 5 consecutive segments differs in at most 2/5 of a bit a segment, rounded
down: 0, 0, 1, 1, 2 bits. So the pair agrees in two consecutive segments. These two segments are the key under
which candidates meet; the longer chains prune them before the full comparison, which is the last chain.

Keys are dealt by range of (key, fingerprint), so a key that a third of all rows share is cut over many tasks.
Of a key with few members all pairs are checked. A key with more than ``CROWD`` members, or one cut by a border
between tasks, is done exactly in another way: two fingerprints differ in at most 2 bits just if both come
within 1 bit of some value. Each member is sent to all such values that keep the key's bits, at most 39, and all
that meet at one value are linked to the smallest of them. Thus work is linear in the members of any key.

Copies of a text are one class from the start; a fingerprint that very many rows share gets its component by broadcast (see ``join_counted``).

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of one or two words are
one shingle; very long texts are fingerprinted whole. An empty table gives an empty result. Columns other than doc_id and text are ignored,
whatever their names (``keep_one`` returns them all). Rows that repeat a doc_id are fingerprinted row by row and linked through the id. A null doc_id gets a
fingerprint, and the component of the documents near it, or null if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blobs, by_size, doc_rows, join_counted, materialize
from .components import components

DISTANCE = 2
#: Bits of the five segments, from the low end.
SEGMENTS = (13, 13, 13, 13, 12)
#: A key with more members goes the linear way.
CROWD = 128

_SHIFTS = np.cumsum((0, *SEGMENTS[:-1]))
_MASKS = [((1 << n) - 1) << int(s) for n, s in zip(SEGMENTS, _SHIFTS)]
_KEYS = [_MASKS[i] | _MASKS[(i + 1) % 5] for i in range(5)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(h: np.ndarray) -> int:
    """The SimHash of hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # bits as bytes, some at a time
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(body: bytes, shingle: int = 3) -> int:
    words = body.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return majority(np.array([digest(text[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the SimHash as a signed 64-bit integer."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 1, 4 << 20):
                yield batch(schema, part.column(0), [_signed(fingerprint(x, shingle)) for x in blobs(part.column(1))])

    return doc_rows(docs).mapInArrow(run, "doc_id long, fp long")


def _chains_hold(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether xors keep within the budget of every chain that begins at segment ``first``."""
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    masks = np.array(_MASKS, np.uint64)
    for length in range(1, 6):
        total += np.bitwise_count(x & masks[(first + length - 1) % 5])
        ok &= total <= length * DISTANCE // 5
    return ok


def _crowd_rows(chain: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every value within 1 bit of each member that keeps the key, and the member's representative."""
    at, who = [fp], [rep]
    for i in range(5):
        own = chain == i
        if own.any():
            flips = np.array([1 << k for k in range(64) if not _KEYS[i] >> k & 1], np.uint64)
            at.append((fp[own][:, None] ^ flips).ravel())
            who.append(np.repeat(rep[own], len(flips)))
    return np.concatenate(at), np.concatenate(who)


def links(classes: DataFrame) -> DataFrame:
    """Links a, b between representatives of distinct fingerprints (columns fp, rep), enough to connect all that are near."""
    schema = pa.schema([("at", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        begun = False  # the first key may have begun in another task

        def emit(part: list[np.ndarray], border: bool) -> Iterator[pa.RecordBatch]:
            """part: sorted whole keys; border: all of it goes the linear way."""
            chain, key, fp, rep = part
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (chain[1:] != chain[:-1])
            group = np.cumsum(new) - 1
            size = np.bincount(group)[group] if len(group) else group
            crowded = (size > CROWD) | border
            for at in range(0, len(key), 20_000):
                some = slice(at, at + 20_000)
                if crowded[some].any():
                    values, who = _crowd_rows(chain[some][crowded[some]], fp[some][crowded[some]], rep[some][crowded[some]])
                    yield batch(schema, values.view(np.int64), who, pa.nulls(len(who), pa.int64()))
            few = np.flatnonzero(~crowded & (size > 1))
            chain, fp, rep, group = chain[few], fp[few], rep[few], group[few]
            for step in range(1, CROWD):
                pair = np.flatnonzero(group[step:] == group[:-step])
                if not len(pair):
                    break
                pair = pair[_chains_hold(fp[pair] ^ fp[pair + step], chain[pair])]
                if len(pair):
                    yield batch(schema, pa.nulls(len(pair), pa.int64()), rep[pair], rep[pair + step])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now = [now[0].astype(np.int64), now[1].view(np.uint64), now[2].view(np.uint64), now[3]]
            held = [np.concatenate(x) for x in zip(held, now)]
            chain, key = held[0], held[1]
            edge = np.flatnonzero((key[1:] != key[:-1]) | (chain[1:] != chain[:-1])) + 1
            if not begun and len(edge):
                yield from emit([x[: edge[0]] for x in held], True)
                held, edge, begun = [x[edge[0] :] for x in held], edge[1:] - edge[0], True
            if begun and len(edge):
                yield from emit([x[: edge[-1]] for x in held], False)
                held = [x[edge[-1] :] for x in held]
            elif len(held[0]) > 200_000:  # a key of very many members: its rows are many enough to go the linear way now
                yield from emit([x[:-1000] for x in held], True)
                held = [x[-1000:] for x in held]  # still a crowd, so the rest goes the same way
        yield from emit(held, True)

    keyed = classes.select(
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("chain"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"), "fp", "rep") for i, m in enumerate(_KEYS)])).alias("k")
    ).select("k.*")
    dealt = keyed.repartitionByRange("chain", "key", "fp").sortWithinPartitions("chain", "key", "fp")
    found = materialize(dealt.mapInArrow(run, "at long, a long, b long"), "near")
    met = found.where("b is null").groupBy("at").agg(F.min("a").alias("root"), F.collect_set("a").alias("all")).where("size(all) > 1")
    return found.where("b is not null").select("a", "b").union(met.select(F.col("root").alias("a"), F.explode("all").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed) and component_id for each row."""
    prints = materialize(fingerprints(docs, shingle), "prints")
    total = prints.count()
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    same_id = prints.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    # rows that repeat a doc_id with other texts tie their classes together
    tied = join_counted(same_id.select("doc_id", F.explode("fps").alias("fp")), classes, "fp", total)
    tied = tied.where("rep is not null").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    known = classes.where("rep is not null").select("fp", "rep")
    roots = components(links(known).union(tied))
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id"))
    return join_counted(prints, named, "fp", total).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents without near copies: of each component the rows with the smallest doc_id stay.

    Rows that share that doc_id all stay, and so do rows without a doc_id.
    """
    groups = near_duplicates(docs, shingle)
    goes = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_tw_id")).distinct()
    return docs.join(goes.hint("shuffle_hash"), docs["doc_id"] == goes["_tw_id"], "left_anti")

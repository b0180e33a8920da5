"""Near copies: texts whose sets of 5-word shingles have a Jaccard likeness of at least 0.8, each pair checked on the sets.

Candidates meet by SimHash, as in ``simhash``: each set has a fingerprint of 64 bits, and fingerprints that differ in at most 2 are
found by pigeonring chains (``simhash_links``). That alone can't find all: at a likeness of 0.8 two fingerprints differ in about 10 bits and often
in 15, and chains for so wide a radius begin with nearly every pair. So texts whose fingerprints are further apart also meet by minima: of each of 180
permutations of the shingles the least is taken, six of them make one of 30 keys, and a pair at 0.8 shares a key but for one in 9,000; a pair
that is more alike, but for fewer. Texts that meet either way, also by way of others, form a loose group, and are then compared by their whole sets.

Equal sets are one class from the start. A loose group of many texts is cut into parts. First each part is compared within itself and with
about 64 texts that all parts of the group share; in a group of copies of one text that connects nearly all. Then only the texts outside the
group's largest component are compared with the whole group, part by part, so no pair is left out and work is linear in a group of copies,
however large. Pieces of work are spread; each gives back no more links than it has texts.

Defined cases: as in ``simhash``. Null and empty texts are equal; texts of up to five words are one shingle. Rows that repeat a doc_id
link their classes. Rows without a doc_id take no part and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, blobs, by_size, doc_rows, join_counted, materialize
from .components import components
from .simhash import links as near_fingerprints
from .simhash import majority

SHINGLE, LIKENESS = 5, 0.8
BANDS, ROWS = 30, 6
#: Most texts and shingles in a part of a loose group, about.
PART_TEXTS, PART_SHINGLES = 1024, 1 << 20
#: Texts of a loose group, about, that all of its parts are compared with.
SHARED = 64

_RANDOM = np.random.default_rng(11)
_FLIP, _TIMES, _MIX = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(3))


def shingles(body: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    words = body.lower().split()
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(text, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    return np.unique(np.array([digest(text[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


def keys(of: np.ndarray) -> np.ndarray:
    """The keys under which a set meets sets like it."""
    least = np.full(len(_FLIP), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(of), 256):
        least = np.minimum(least, ((of[at : at + 256] ^ _FLIP[:, None]) * _TIMES[:, None]).min(1))
    return (least * _MIX).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)


def _name(of: np.ndarray) -> int:
    """A set's class."""
    return xxhash.xxh64_intdigest(of.tobytes(), 42)


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the class), n (its shingles), sim (the SimHash of its set) and keys for each row with a doc_id."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("sim", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 1, 4 << 20):
                sets = [shingles(x, shingle) for x in blobs(part.column(1))]
                yield batch(schema, part.column(0), _signed([_name(s) for s in sets]), [len(s) for s in sets], _signed([majority(s) for s in sets]), [keys(s).view(np.int64) for s in sets])

    return doc_rows(docs.where("doc_id is not null")).mapInArrow(run, "doc_id long, fp long, n long, sim long, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    schema = pa.schema([("fp", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 1, 4 << 20):
                sets = [shingles(x, shingle) for x in blobs(part.column(1))]
                yield batch(schema, _signed([_name(s) for s in sets]), [s.tobytes() for s in sets])

    return doc_rows(docs).mapInArrow(run, "fp long, set binary")


def alike(sets: list[np.ndarray], likeness: float = LIKENESS) -> np.ndarray:
    """For each set the smallest number of a set that it is linked to, itself or by way of others."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(n), sizes)
    common = np.bincount(column, minlength=len(value))[column] > 1  # a shingle of one text is in no intersection
    column, holder = column[common], holder[common]
    order = np.argsort(column, kind="stable")
    posted, edge = holder[order], np.searchsorted(column[order], np.arange(len(value) + 1))
    begin = np.searchsorted(holder, np.arange(n + 1))
    root = np.arange(n)
    for i in range(n):
        own = column[begin[i] : begin[i + 1]]
        if not len(own):
            continue
        met = np.bincount(np.concatenate([posted[edge[c] : edge[c + 1]] for c in own.tolist()]), minlength=n)
        near = np.flatnonzero(met >= likeness * (sizes[i] + sizes - met) - 1e-9)
        roots = np.unique(root[near])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    return root


def met(keyed: DataFrame) -> DataFrame:
    """Links a, b that connect all classes which share a key; ``keyed``: fp, key.

    Keys are dealt by range of (key, fp) and streamed: each class is linked to the first of its key in its task, and the first classes of
    keys at borders, two a task, to each other. A key that very many classes share is cut over many tasks.
    """
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, begun = None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            start = np.flatnonzero(np.concatenate(([key[0] != now], key[1:] != key[:-1])))
            to = np.concatenate(([first], fp[start]))[np.cumsum(np.isin(np.arange(len(key)), start, assume_unique=True))]
            link = to != fp
            yield batch(schema, pa.nulls(int(link.sum()), pa.int64()), to[link], fp[link])
            if not begun:
                yield batch(schema, key[:1], fp[:1], fp[:1])
                begun = True
            if len(start):
                now, first = int(key[-1]), int(fp[start[-1]])
        if begun:
            yield batch(schema, [now], [first], [first])

    found = materialize(keyed.select("key", "fp").repartitionByRange("key", "fp").sortWithinPartitions("key", "fp").mapInArrow(run, "key long, a long, b long"), "met")
    # at most two rows a task
    border = found.where("key is not null").groupBy("key").agg(F.min("a").alias("a"), F.collect_set("b").alias("all")).where("size(all) > 1")
    return found.where("key is null").select("a", "b").union(border.select("a", F.explode("all").alias("b")).where("a <> b"))


def simhash_links(once: DataFrame) -> DataFrame:
    """Links a, b between a class of each fingerprint, enough to connect all that differ in 1 or 2 bits; ``once``: fp, sim, one row a class."""
    return near_fingerprints(once.groupBy(F.col("sim").alias("fp")).agg(F.min("fp").alias("rep")))


def _compared(work: DataFrame, by: list[str], likeness: float) -> DataFrame:
    """Links a, b that connect all alike texts of each piece of work; work: fp, set and the columns of ``by``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        fps, at = np.unique(table.column("fp").to_numpy(), return_index=True)  # a text may stand on both sides
        root = alike([np.frombuffer(s, np.uint64) for s in table.column("set").take(pa.array(at)).to_pylist()], likeness)
        some = np.flatnonzero(root != np.arange(len(root)))
        return pa.Table.from_batches([batch(schema, fps[root[some]], fps[some])], schema)

    return materialize(work.groupBy(*by).applyInArrow(run, "a long, b long"), "alike")


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0), F.col(n) - 1)


def links(docs: DataFrame, made: DataFrame, shingle: int = SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """Links a, b between classes, enough to connect all that are alike. ``made``: what ``classes`` gave."""
    once = made.groupBy("fp").agg(F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("keys").alias("keys"), F.min("doc_id").alias("doc_id"))
    once = materialize(once, "classes")
    # classes of equal fingerprints meet as those of equal keys do
    candidates = simhash_links(once).union(met(once.select("fp", F.explode(F.array_append("keys", F.col("sim"))).alias("key"))))
    loose = components(candidates).withColumnsRenamed({"node": "fp", "root": "loose"})
    held = materialize(once.select("fp", "n", "doc_id").join(loose, "fp"), "loose")
    count = F.count(F.lit(1))
    parts = F.greatest(F.ceil(count / PART_TEXTS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int")
    sizes = held.groupBy("loose").agg(parts.alias("parts"), count.alias("n"))
    sized = join_counted(held.select("fp", "doc_id", "loose"), sizes, "loose", held.count())
    shared = (F.col("parts") > 1) & (F.pmod(F.xxhash64("fp", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("n") / SHARED))) == 0)
    sized = sized.select("fp", "doc_id", "loose", "parts", F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part"), shared.alias("shared"))
    # a doc_id that is repeated may bring texts of other classes: the join on fp leaves them out
    wanted = docs.join(held.select(F.col("doc_id").alias("_tw_id")).distinct().hint("shuffle_hash"), docs["doc_id"] == F.col("_tw_id"), "left_semi")
    texts = materialize(sized.join(_sets(wanted, shingle).groupBy("fp").agg(F.first("set").alias("set")), "fp"), "texts")
    # a part is compared within itself and with the shared texts of its group
    own = texts.select("loose", "fp", "set", F.explode(F.when(F.col("shared"), _upto("parts")).otherwise(F.array("part"))).alias("i"))
    first = _compared(own, ["loose", "i"], likeness)
    # what these leave outside the largest component of a group of several parts is compared with the whole group
    several = texts.where("parts > 1")
    if several.isEmpty():
        return first
    within = first.join(several.select(F.col("fp").alias("a")), "a")
    roots = components(within).withColumnsRenamed({"node": "fp", "root": "root"})
    cut = materialize(several.select("fp", "loose", "parts", "part").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "cut")
    weights = cut.groupBy("loose", "root").agg(count.alias("w")).groupBy("loose").agg(F.max(F.struct("w", "root")).alias("m"), F.sum("w").alias("n"))
    weights = weights.where("n > m.w").select("loose", "n", F.col("m.root").alias("main"), F.ceil((F.col("n") - F.col("m.w")) / PART_TEXTS).cast("int").alias("others"))
    left = join_counted(cut, weights, "loose", cut.count())
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    whole = F.transform(_upto("others"), lambda i: pair(i, F.col("part")))
    outside = F.transform(_upto("parts"), lambda j: pair(F.pmod(F.xxhash64("fp"), "others").cast("int"), j))
    left = left.select("fp", "loose", F.when(F.col("root") == F.col("main"), whole).otherwise(F.array_distinct(F.concat(whole, outside))).alias("p"))
    more = left.join(texts.select("fp", "set"), "fp").select("loose", "fp", "set", F.explode("p").alias("p")).select("loose", "fp", "set", "p.i", "p.j")
    return first.union(_compared(more, ["loose", "i", "j"], likeness))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """doc_id, fp (the class of equal sets) and component_id, the smallest doc_id of the component, for each row with a doc_id."""
    made = materialize(classes(docs, shingle), "sets")
    rows, total = made.select("doc_id", "fp"), made.count()
    # rows that repeat a doc_id with other texts tie their classes together
    tied = rows.groupBy("doc_id").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where("size(fps) > 1").select("a", F.explode("fps").alias("b"))
    roots = materialize(components(links(docs, made, shingle, likeness).union(tied)).withColumnRenamed("node", "fp"), "roots")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(least, "least")
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("texts"))
    named = join_counted(named, firsts, "root", named.count(), "texts").select("fp", "n", "component_id")
    return join_counted(rows, named, "fp", total).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """The documents without near copies: of each component the rows with the smallest doc_id stay, and rows without a doc_id."""
    goes = near_copies(docs, shingle, likeness).where("doc_id <> component_id").select(F.col("doc_id").alias("_tw_id")).distinct()
    return docs.join(goes.hint("shuffle_hash"), docs["doc_id"] == goes["_tw_id"], "left_anti")

"""Language-model scoring by causal self-attention over subword ids.

1. Documents are read once into blocks. A block has a dictionary of its words, the words' subwords (byte-level BPE of a public
   vocabulary), its documents as numbers of words, and counts of words and subwords in its training documents.
2. Word counts are summed over all blocks. A block's dictionary is sorted by a hash and cut by ranges of it; a range of all blocks
   meets in one group of about PART_WORDS words, and each block gets back the counts of its own words: no vocabulary is broadcast.
   A row holds the words of one block and range, side by side, and there are as many ranges as words ask for. The commonest
   word of all comes once a block, beside the block's 10,000s of others, so it weighs on no group.
3. The attention model learns from all of the training text, in windows that stand end to end, block after block: each task
   trains from the same start, and the weights are averaged, in rounds. Each window is learned from once, whatever the size of the input.
   Subword frequencies within output classes come from all training text.
4. Each block is scored. Texts are cut into overlapping windows; every token is predicted once, with at least
   ``OVERLAP`` tokens before it where the text has them.

A subword's probability is that of its class, given the context, times its own in the class: given the context for the most
frequent subwords, whose classes are made of those that follow like company in all training text; a fixed share of the counts for rare ones.
End of text is a subword too, so scores are probabilities of whole texts.

Defined cases: null and empty texts are the end token alone. Very long texts are one block and are scored by slices of their windows.
An empty table gives an empty result. Without training text all counts are 0 and the model stays at its start. Repeated rows are
counted and scored row by row; a null doc_id counts as the empty text for held_out. Equally frequent subwords are ordered by their ids.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import WHITE, batch, bound_batches, by_size, materialize, text_bytes
from .labelled import remainder

BLOCK_BYTES = 8 << 20
#: Most blocks of a file: a reader decodes, and a writer holds, a file's rows all at once.
FILE_BLOCKS = 4
#: Words of a group in which counts are summed, about.
PART_WORDS = 1 << 19
HELD_OUT_OF, HELD_OUT = 7, 2
CONTEXT, OVERLAP = 32, 4
DIMENSIONS = 16
CLASSES, MEMBERS = 32, 32  # the most frequent subwords, in classes of like company
TOP = CLASSES * MEMBERS
GROUPS = 8  # output classes of all other subwords
COMPANY = 128  # the most frequent subwords before, by which those classes are made
#: Rounds share out the windows of every block, so each training window is learned from.
ROUNDS = 2
#: Windows of a step.
BATCH = 128
#: Windows that are scored at once: fewer need more calls for classes, more don't stay in a core's cache.
SCORED = 512
_MOST = np.float32(60)
#: A row of exponentials with a sum between these has no logit above _MOST, and none below -_MOST that would change the sum.
_LEAST, _LARGEST = 1e-18, 1e26
_CAUSAL = np.triu(np.full((CONTEXT, CONTEXT), -1e9, np.float32), 1)


# --- blocks


class Segmenter:
    """Words to subwords of a public vocabulary; a word is taken as it stands after a space."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.library = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1  # stands for the end of a text
        self.tokens = [b""] * self.end
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.opens = np.array([t[:1] == b" " for t in self.tokens])

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of subwords of each word, and all subwords in order."""
        return self.segment_spaced(pa.array(words, pa.binary()))

    def segment_spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """segment() of an array's words."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.array(self.library.encode_ordinary(_spaced(words).decode("utf-8", "replace")), np.int64)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words):  # words of other white space run into each other
            each = [self.library.encode_ordinary((b" " + w).decode("utf-8", "replace")) for w in words.to_pylist()]
            return np.array([len(x) for x in each]), np.array([i for x in each for i in x], np.int64)
        return np.diff(np.append(starts, len(ids))), ids


_SEGMENTERS: dict[int, Segmenter] = {}


def segmenter(raw: bytes, pattern: str) -> Segmenter:
    """One for each Python worker and vocabulary."""
    key = hash((raw, pattern))
    if key not in _SEGMENTERS:
        _SEGMENTERS[key] = Segmenter(raw, pattern)
    return _SEGMENTERS[key]


_IS_WORD = bytes(b not in WHITE for b in range(256))


def _coded(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words of each text, the words as numbers, and the distinct words that these count; A-Z lower-cased."""
    ends = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    low = (bodies.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if bodies.buffers()[2] else b"").lower()
    ends -= ends[0]
    of_word = np.frombuffer(low.translate(_IS_WORD), bool)
    begins = of_word.copy()
    begins[1:] &= ~of_word[:-1]
    first = ends[:-1][ends[1:] > ends[:-1]]
    begins[first] = of_word[first]
    n = np.diff(np.searchsorted(np.flatnonzero(begins), ends))
    # words without the white space between them, one behind the other
    letters = np.frombuffer(low, np.uint8)[of_word]
    offsets = np.append(np.flatnonzero(begins[of_word]), len(letters)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return n, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _words(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    n, which, distinct = _coded(bodies)
    return n, which.astype(np.int64), distinct.to_pylist()


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where words end, from 0 on, and their bytes, one behind the other."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return ends - ends[0], data[ends[0] : ends[-1]]


def _spaced(words: pa.Array) -> bytes:
    """The words, each behind a space."""
    ends, letters = _letters(words)
    out = np.full(len(letters) + len(words), 32, np.uint8)
    own = np.ones(len(out), bool)
    own[ends[:-1] + np.arange(len(words))] = False
    out[own] = letters
    return out.tobytes()


#: Odd factors for the places of a word's first bytes in its hash; bytes further on take them again.
_FACTORS = np.random.default_rng(8).integers(1 << 62, dtype=np.uint64, size=64) * np.uint64(2) + np.uint64(1)
_MIXED = np.random.default_rng(9).integers(1 << 63, dtype=np.uint64, size=256)


def _hashes(words: pa.Array) -> np.ndarray:
    """32 bits a word (no word is empty), of its bytes alone: sums of random numbers for bytes by factors for places, mixed."""
    ends, letters = _letters(words)
    if not len(words):
        return np.zeros(0, "<u4")
    place = np.arange(len(letters)) - np.repeat(ends[:-1], np.diff(ends))
    h = np.add.reduceat(_MIXED.take(letters) * _FACTORS.take(place & 63), ends[:-1])
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype("<u4")


def _pack(ids: list[int], held: list[bool], bodies: pa.Array, v) -> tuple:
    """A block's row, its words sorted by hash; word number 0 stands for the end of a text."""
    n, which, words = _coded(bodies)
    hashes = _hashes(words)
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    words = words.take(pa.array(order))
    sizes = n + 1
    ends = np.cumsum(sizes)
    tokens = np.zeros(int(sizes.sum()), "<i4")
    is_word = np.ones(len(tokens), bool)
    is_word[ends - 1] = False
    tokens[is_word] = place.take(which)
    learn = np.repeat(~np.array(held, bool), sizes)
    train = np.bincount(tokens[learn], minlength=len(words) + 1)
    n, sub = v.segment_spaced(words)
    n, sub = np.concatenate(([1], n)).astype("<i4"), np.concatenate(([v.end], sub)).astype("<u4")
    seen = np.bincount(sub, np.repeat(train, n), v.end + 1)
    found = np.flatnonzero(seen)
    ends, letters = _letters(words)
    return (
        ids, held, sizes.tolist(), tokens.tobytes(), letters.tobytes(), train[1:].astype("<i8").tobytes(), int(train[0]),
        n.tobytes(), sub.tobytes(), found.tolist(), seen[found].astype(np.int64).tolist(),
        np.diff(ends).astype("<i4").tobytes(), hashes[order].tobytes(), len(words),
    )


_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()),
        ("words", pa.binary()), ("train", pa.binary()), ("train_docs", pa.int64()), ("sub_n", pa.binary()), ("sub", pa.binary()),
        ("sub_ids", pa.list_(pa.int32())), ("sub_counts", pa.list_(pa.int64())), ("word_sizes", pa.binary()), ("hashes", pa.binary()), ("n_words", pa.int64()),
    ]
)
_BLOCK_DDL = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary, train binary, train_docs long, sub_n binary, sub binary, sub_ids array<int>, sub_counts array<long>, word_sizes binary, hashes binary, n_words long"


def blocks(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, number = segmenter(raw.value, pattern), TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            return batch(_BLOCK, *([x] for x in (number, *_pack(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).chunk(0), v))))

        for b in batches:
            for part in by_size(b, 2, 1 << 20):
                held.append(part)
                size += part.column(2).nbytes
                if size >= BLOCK_BYTES:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT).alias("held"), text_bytes().alias("body"))
    return materialize(rows.mapInArrow(run, _BLOCK_DDL), "blocks", maxRecordsPerFile=FILE_BLOCKS)


def _binaries(ends: np.ndarray, data) -> pa.Array:
    """Values that stand one behind the other in ``data``; ends: 0 and where each ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _joined(column: pa.ChunkedArray) -> pa.Buffer:
    """All values of a binary column, one behind the other."""
    return pa.py_buffer(b"".join(x.as_buffer() for x in column))


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def word_counts(made: DataFrame) -> DataFrame:
    """block, part, c (the counts, in all training text, of the block's words of a range of hashes), and on one row a range its n_words that have a count and their n_train."""
    parts = max(1, math.ceil((made.agg(F.sum("n_words")).first()[0] or 0) / PART_WORDS))
    dealt = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("sizes", pa.binary()), ("train", pa.binary())])
    counted = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("c", pa.binary()), ("n_words", pa.int64()), ("n_train", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << 32) // parts for i in range(parts + 1)], np.int64)
        for b in batches:
            for i in range(b.num_rows):
                words, sizes, hashes, train = (b.column(k)[i].as_buffer() for k in (1, 2, 3, 4))
                at = np.searchsorted(np.frombuffer(hashes, "<u4").astype(np.int64), edges)
                some = np.flatnonzero(at[1:] > at[:-1])
                if len(some):
                    at = np.append(at[some], at[-1])
                    yield batch(dealt, some, [b.column(0)[i].as_py()] * len(some), _binaries(_ends(np.frombuffer(sizes, "<i4"))[at], words), _binaries(at * 4, sizes), _binaries(at * 8, train))

    def count(table: pa.Table) -> pa.Table:
        sizes = np.frombuffer(_joined(table.column("sizes")), "<i4")
        coded = _binaries(_ends(sizes), _joined(table.column("words"))).dictionary_encode()
        which = coded.indices.to_numpy()
        found = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(found, which, np.frombuffer(_joined(table.column("train")), "<i8"))
        ends = _ends([len(x.as_buffer()) * 2 for x in table.column("sizes")])
        once = lambda x: [int(x)] + [0] * (table.num_rows - 1)
        out = batch(counted, table.column("block").combine_chunks(), table.column("part").combine_chunks(), _binaries(ends, found[which].tobytes()), once((found > 0).sum()), once(found.sum()))
        return pa.Table.from_batches([out])

    rows = made.select("block", "words", "word_sizes", "hashes", "train").mapInArrow(deal, "part long, block long, words binary, sizes binary, train binary")
    return materialize(rows.groupBy("part").applyInArrow(count, "block long, part long, c binary, n_words long, n_train long"), "counts")


# --- the model


@dataclass
class Shape:
    """Subwords as the model sees them; the last subword is the end of a text.

    row: input vector. kind: output class. member: place in a class of frequent subwords, else -1. share: log share
    of its class in the training text plus one. prior: log share of each class.
    """

    row: np.ndarray
    kind: np.ndarray
    member: np.ndarray
    share: np.ndarray
    prior: np.ndarray

    def __post_init__(self) -> None:
        self.kind8 = self.kind.astype(np.uint8)  # sorted by radix


def frequent(counts: np.ndarray) -> np.ndarray:
    """Subwords by count, the end of a text first."""
    order = np.argsort(-counts, kind="stable")
    return np.concatenate(([len(counts) - 1], order[order != len(counts) - 1]))


def company(made: DataFrame, order: np.ndarray) -> np.ndarray:
    """How often each of the TOP subwords follows each of the COMPANY ones, over all training text."""
    rank = np.full(len(order), TOP, np.int64)
    rank[order[:TOP]] = np.arange(min(TOP, len(order)))
    shared = made.sparkSession.sparkContext.broadcast(rank)
    schema = pa.schema([("part", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, total = shared.value, np.zeros(COMPANY * TOP, np.int64)
        for b in batches:
            for row in b.to_pylist():
                stream = Stream(row["tokens"], row["sizes"], row["sub_n"], row["sub"])
                learn = np.repeat(~np.array(row["held"], bool), stream.end - stream.begin)
                after = rank[stream.subs]
                before = np.concatenate((rank[len(rank) - 1 : len(rank)], after[:-1]))
                use = learn & (before < COMPANY) & (after < TOP)
                total += np.bincount(before[use] * TOP + after[use], minlength=COMPANY * TOP)
        yield batch(schema, [TaskContext.get().partitionId()], [total.tobytes()])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "counts": [sum(np.frombuffer(c, np.int64) for c in rows["counts"]).tobytes()]})

    local = _inputs(made).mapInArrow(run, "part long, counts binary")
    found = _tree(local, add, "part long, counts binary", made.rdd.getNumPartitions(), COMPANY * TOP * 8)
    return np.zeros((COMPANY, TOP)) if found is None else np.frombuffer(found["counts"], np.int64).reshape(COMPANY, TOP).astype(np.float64)


def alike(follows: np.ndarray) -> np.ndarray:
    """A class for each of the TOP subwords, all of one size: halved again and again along the direction in which their company differs most."""
    n = follows + 0.05
    x = np.log(n / (n.sum(0, keepdims=True) * n.sum(1, keepdims=True)) * n.sum()).T
    x = (x - x.mean(0)) * np.sqrt(follows.sum(1) / max(follows.sum(), 1) + 1e-6)
    parts = [np.arange(TOP)]
    while len(parts) < CLASSES:
        halves = []
        for own in parts:
            centred = x[own] - x[own].mean(0)
            along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
            order = own[np.argsort(along, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    out = np.zeros(TOP, np.int64)
    for i, own in enumerate(parts):
        out[own] = i
    return out


def shape(counts: np.ndarray, tokens: list[bytes], order: np.ndarray, classes: np.ndarray) -> Shape:
    n = counts + 1.0
    kind, member = np.zeros(len(n), np.int64), np.full(len(n), -1, np.int64)
    kind[order[:TOP]] = classes
    for c in range(CLASSES):
        own = order[:TOP][classes == c]
        member[own] = np.arange(len(own))
    spaced = np.array([t[:1] == b" " for t in tokens] + [False])
    half = GROUPS // 2
    for k, own in enumerate((True, False)):  # of each sort groups of like mass, by frequency
        rest = order[TOP:][spaced[order[TOP:]] == own]
        upto = np.cumsum(n[rest])
        if len(rest):
            kind[rest] = CLASSES + k * half + np.minimum((upto * half / upto[-1]).astype(int), half - 1)
    total = np.bincount(kind, n, CLASSES + GROUPS)
    row = TOP + kind
    row[order[:TOP]] = np.arange(TOP)
    prior = np.log(np.maximum(total, 1e-9) / total.sum())
    return Shape(row.astype(np.int32), kind.astype(np.int32), member.astype(np.int32), np.log(n / total[kind]).astype(np.float32), prior.astype(np.float32))


_D = DIMENSIONS
_SIZES = {"e": (TOP + CLASSES + GROUPS, _D), "p": (CONTEXT, _D), "q": (_D, _D), "k": (_D, _D), "v": (_D, _D), "o": (_D, _D), "w": (_D, CLASSES + GROUPS), "b": (CLASSES + GROUPS,), "u": (CLASSES, _D, MEMBERS), "c": (CLASSES, MEMBERS)}


def start(s: Shape, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights that give every subword its share of the training text, whatever comes before."""
    rng = np.random.default_rng(seed)
    m = {name: rng.normal(0, 0.3 if name == "e" else 0.2, size).astype(np.float32) for name, size in _SIZES.items()}
    m["p"] *= 0
    m["w"] *= 0.1
    m["u"] *= 0.1
    m["b"] = s.prior.copy()
    top = s.member >= 0
    m["c"] *= 0
    m["c"][s.kind[top], s.member[top]] = s.share[top]
    return m


def flat(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[n].ravel() for n in _SIZES])


def unflat(a: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, size in _SIZES.items():
        out[n] = a[at : at + math.prod(size)].reshape(size)
        at += math.prod(size)
    return out


def _bounded(z: np.ndarray) -> np.ndarray:
    """Logits are small: those beyond _MOST either way count as that, so no row of exponentials sums to 0."""
    return np.clip(z, -_MOST, _MOST, out=z)


def _powers(z: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of bounded logits, and the sums of their rows; a mask is in z already.

    Sums tell whether a bound matters: none does in a row whose sum is far from both ends, so logits are mostly not read for it.
    """
    ones = np.ones(z.shape[-1], z.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = e.reshape(-1, len(ones)) @ ones
    if len(total) and not (total.min() > _LEAST and total.max() < _LARGEST):
        _bounded(z)
        if mask is not None:
            z += mask
        np.exp(z, out=e)
        total = e.reshape(-1, len(ones)) @ ones
    return e, total


def _through(m: dict[str, np.ndarray]) -> np.ndarray:
    """There is one head, as wide as the hidden states: queries meet keys by q k', values come out by v o, and each product is one matrix."""
    return np.concatenate((m["q"] @ m["k"].T * m["q"].dtype.type(1 / math.sqrt(DIMENSIONS)), m["v"] @ m["o"]), axis=1)


def attend(m: dict[str, np.ndarray], rows: np.ndarray, since: int = 0) -> tuple:
    """Hidden states of windows of input rows from a position on, and what the gradient needs; attention's weights are a by its sums."""
    d = DIMENSIONS
    x = m["e"].take(rows, axis=0)
    x += m["p"]
    yv = (x.reshape(-1, d) @ _through(m)).reshape(*rows.shape, 2 * d)
    y, v = yv[:, :, :d], yv[:, :, d:]
    a = y[:, since:] @ x.swapaxes(1, 2)
    a += _CAUSAL[since:]
    a, sums = _powers(a, _CAUSAL[since:])
    o = a @ v  # few columns are divided, not a's many
    o /= sums.reshape(*o.shape[:2], 1)
    return x[:, since:] + o, x, y, v, a, o, sums


def _picked(z: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log softmax of rows at one place each; z is used up."""
    at = np.arange(len(z)) * z.shape[1] + which
    e, total = _powers(z)  # which bounds z where that matters
    return _bounded(z.take(at)) - np.log(total)


def _by_class(edge: np.ndarray) -> list[tuple[int, slice]]:
    """Classes of frequent subwords that have rows, and their rows: those of class c from edge[c] on."""
    edge = edge.tolist()
    return [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edge, edge[1:])) if a < b]


def _within(m: dict[str, np.ndarray], h: np.ndarray, classes: list[tuple[int, slice]], top: int) -> np.ndarray:
    """Logits of the members of each row's class; rows stand together by class."""
    z = np.empty((top, MEMBERS), h.dtype)
    for c, of in classes:
        own = z[of]
        np.matmul(h[of], m["u"][c], out=own)
        np.add(own, m["c"][c], out=own)
    return z


def logs(m: dict[str, np.ndarray], s: Shape, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Log probability of each target: of its class, then of the member in it; rare subwords have a fixed share of their class."""
    order = np.argsort(s.kind8.take(targets), kind="stable")
    out = np.empty(len(order), h.dtype)
    out[order] = _sorted_logs(m, s, h.take(order, axis=0), targets.take(order))
    return out


def _sorted_logs(m: dict[str, np.ndarray], s: Shape, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """logs() of positions that stand together by the class of their target."""
    kinds = s.kind.take(targets)
    edge = np.searchsorted(kinds, np.arange(CLASSES + 1))
    z = h @ m["w"]
    z += m["b"]
    found = _picked(z, kinds)
    top = int(edge[CLASSES])
    found[:top] += _picked(_within(m, h, _by_class(edge), top), s.member.take(targets[:top]))
    found[top:] += s.share.take(targets[top:])
    return found


def _errors(z: np.ndarray, which: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Gradient at logits whose right places are ``which``, each row weighing its share. Bounds as in _picked."""
    e, total = _powers(z)
    e *= (share / total)[:, None]
    e.reshape(-1)[np.arange(len(e)) * e.shape[1] + which] -= share
    return e


def _summed(like: np.ndarray, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x added up by row number, in an array of the shape of ``like``."""
    width = like.shape[1]
    at = (rows.astype(np.int64) * width)[:, None] + np.arange(width)
    return np.bincount(at.ravel(), x.ravel(), like.size).reshape(like.shape).astype(like.dtype)


def gradient(m: dict[str, np.ndarray], s: Shape, rows: np.ndarray, targets: np.ndarray, weigh: np.ndarray) -> dict[str, np.ndarray]:
    h, x, y, v, a, o, sums = attend(m, rows)
    n, d = rows.size, DIMENSIONS
    # positions stand together by the class of their target
    order = np.argsort(s.kind8.take(targets.ravel()), kind="stable")
    of_target = targets.ravel().take(order)
    kinds, sorted_h = s.kind.take(of_target), h.reshape(n, d).take(order, axis=0)
    share = (weigh / weigh.sum()).ravel().take(order)
    edge = np.searchsorted(kinds, np.arange(CLASSES + 1))
    top, classes = int(edge[CLASSES]), _by_class(edge)
    z = sorted_h @ m["w"]
    z += m["b"]
    z = _errors(z, kinds, share)
    ones = np.ones(n, z.dtype)
    g = {"w": sorted_h.T @ z, "b": ones @ z, "u": np.zeros_like(m["u"]), "c": np.zeros_like(m["c"])}
    back = z @ m["w"].T
    z = _errors(_within(m, sorted_h, classes, top), s.member.take(of_target[:top]), share[:top])
    inner, turned = np.empty((top, d), z.dtype), np.ascontiguousarray(m["u"].swapaxes(1, 2))
    for c, of in classes:
        own = z[of]
        np.matmul(sorted_h[of].T, own, out=g["u"][c])
        np.matmul(own, turned[c], out=inner[of])
        np.matmul(ones[of], own, out=g["c"][c])
    head = back[:top]
    head += inner
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    dh = back.take(place, axis=0)
    do = dh / sums[:, None]  # a isn't divided by its sums
    less = (do * o.reshape(n, d)) @ np.ones(d, o.dtype)  # do @ o is da times a, summed over a row
    do = do.reshape(h.shape)
    da = do @ v.swapaxes(1, 2)
    da -= less.reshape(*a.shape[:2], 1)
    da *= a
    dyv = np.empty((*rows.shape, 2 * d), back.dtype)
    np.matmul(da, x, out=dyv[:, :, :d])
    np.matmul(a.swapaxes(1, 2), do, out=dyv[:, :, d:])
    dx = (da.swapaxes(1, 2) @ y).reshape(n, d)
    dx += dh
    dyv = dyv.reshape(n, 2 * d)
    dx += dyv @ _through(m).T
    into = x.reshape(n, d).T @ dyv
    of_qk, of_vo = into[:, :d] * a.dtype.type(1 / math.sqrt(d)), into[:, d:]
    g |= {"q": of_qk @ m["k"], "k": of_qk.T @ m["q"], "v": of_vo @ m["o"].T, "o": m["v"].T @ of_vo}
    g["p"] = dx.reshape(h.shape).sum(0)
    g["e"] = _summed(m["e"], rows.ravel(), dx)
    return g


def learn(m: dict[str, np.ndarray], s: Shape, rows: np.ndarray, targets: np.ndarray, weigh: np.ndarray, rate: float, seed: int) -> dict[str, np.ndarray]:
    """Adam over the windows, once, in random order."""
    order = np.random.default_rng(seed).permutation(len(rows))
    w = flat(m).astype(np.float32)
    first, second, some_w, steps = np.zeros_like(w), np.zeros_like(w), np.empty_like(w), -(-len(rows) // BATCH)
    for step in range(1, steps + 1):
        some = order[(step - 1) * BATCH : step * BATCH]
        g = flat(gradient(unflat(w), s, rows.take(some, axis=0), targets.take(some, axis=0), weigh.take(some, axis=0)))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1))) * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        # means of g and g g are 0.1 first and 0.01 second: w -= now 0.1 first / (sqrt(0.01 second) + 1e-8), without new arrays
        first *= np.float32(0.9)
        first += g
        second *= np.float32(0.99)
        np.multiply(g, g, out=g)
        second += g
        np.sqrt(second, out=g)
        g += np.float32(1e-7)
        np.divide(first, g, out=some_w)
        some_w *= np.float32(now)
        w -= some_w
    return unflat(w)


# --- windows of a block


class Stream:
    """A block's subwords in order, and the windows over its documents."""

    def __init__(self, tokens: bytes, sizes, sub_n: bytes, sub: bytes):
        self.tokens, self.sizes = np.frombuffer(tokens, "<i4"), np.asarray(sizes, np.int64)
        n, sub = np.frombuffer(sub_n, "<i4"), np.frombuffer(sub, "<i4")
        self.subs = pa.ListArray.from_arrays(pa.array(_ends(n).astype(np.int32)), pa.array(sub)).take(pa.array(self.tokens)).flatten().to_numpy()
        self.end = np.cumsum(np.add.reduceat(n[self.tokens], np.cumsum(self.sizes) - self.sizes, dtype=np.int64))  # of each document
        self.begin = np.concatenate(([0], self.end[:-1]))
        step = CONTEXT - OVERLAP
        count = np.maximum(0, -(-(self.end - self.begin - CONTEXT) // step)) + 1
        self.doc = np.repeat(np.arange(len(self.sizes)), count)
        number = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        self.start = self.begin[self.doc] + step * number
        self.fresh = np.where(number == 0, 0, OVERLAP)  # positions before it were scored by the window before

    def windows(self, which: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input rows, target subwords, and which positions are scored here."""
        return self.cut(self.start[which], self.end[self.doc[which]], self.fresh[which], s)

    def lessons(self, held, number: int, rounds: int, s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As windows(), of the training texts that a round learns from. Here windows stand end to end; all rounds together take each once."""
        size = np.where(np.asarray(held, bool), 0, -(-(self.end - self.begin) // CONTEXT))
        doc = np.repeat(np.arange(len(size)), size)
        start = self.begin[doc] + CONTEXT * (np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size))
        return self.cut(start[number::rounds], self.end[doc[number::rounds]], np.zeros(len(doc[number::rounds]), np.int64), s)

    def cut(self, start: np.ndarray, end: np.ndarray, fresh: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = start[:, None] + np.arange(CONTEXT)
        scored = (at < end[:, None]) & (np.arange(CONTEXT) >= fresh[:, None])
        at = np.minimum(at, len(self.subs) - 1)
        before = np.where(at > 0, self.subs[at - 1], len(s.row) - 1)  # before a text stands the end of another
        return s.row[before], self.subs[at], scored

    def scores(self, m: dict[str, np.ndarray], s: Shape) -> np.ndarray:
        """Log10 probability of each document."""
        found = np.empty(len(self.subs), np.float32)
        inputs = np.empty(len(self.subs) + CONTEXT, np.uint16)  # what stands before each subword, and room for the last window
        inputs[0] = inputs[len(self.subs) :] = s.row[-1]
        inputs[1 : len(self.subs)] = s.row.take(self.subs[:-1])
        inputs = np.lib.stride_tricks.sliding_window_view(inputs, CONTEXT)
        kinds = s.kind8.take(self.subs)
        size = np.minimum(self.end[self.doc] - self.start, CONTEXT)
        for since in (0, OVERLAP):  # first windows, then those whose first positions were scored by the window before
            own = np.flatnonzero(self.fresh == since)
            for at in range(0, len(own), SCORED):
                which = own[at : at + SCORED]
                h = attend(m, inputs[self.start[which]], since)[0]
                n = size[which] - since
                begin = np.cumsum(n) - n
                step = np.arange(n.sum())
                token = step + np.repeat(self.start[which] + since - begin, n)
                order = np.argsort(kinds.take(token), kind="stable")
                token = token.take(order)
                place = (step + np.repeat(h.shape[1] * np.arange(len(which)) - begin, n)).take(order)
                found[token] = _sorted_logs(m, s, h.reshape(-1, DIMENSIONS).take(place, axis=0), self.subs.take(token))
        return np.add.reduceat(found, self.begin, dtype=np.float64) / math.log(10)


def _inputs(made: DataFrame) -> DataFrame:
    return made.select("held", "sizes", "tokens", "sub_n", "sub")


#: Results of tasks that one task merges, at most, and their bytes, about: a group is held whole, so it may not grow with the number of tasks.
MERGED, MERGED_BYTES = 64, 8 << 20


def _tree(local: DataFrame, merge, ddl: str, tasks: int, size: int):
    """One row out of one row of ``size`` bytes a task, a few merged at a time; None if there is none."""
    few = max(2, min(MERGED, MERGED_BYTES // size))
    while True:
        tasks = -(-tasks // few)
        local = local.withColumn("part", F.pmod("part", F.lit(tasks))).groupBy("part").applyInPandas(merge, ddl)
        if tasks <= 1:
            return local.first()


_WEIGHTS = pa.schema([("part", pa.int64()), ("windows", pa.int64()), ("weights", pa.binary())])


def average(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Mean of weights by their windows."""
    n = rows["windows"].to_numpy(np.float64)
    total = sum(w * np.frombuffer(b, np.float32).astype(np.float64) for w, b in zip(n, rows["weights"]))
    return pd.DataFrame({"part": [key[0]], "windows": [int(n.sum())], "weights": [(total / n.sum()).astype(np.float32).tobytes()]})


def train(made: DataFrame, s: Shape, rounds: int = ROUNDS, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Weights learned from all training text, in rounds of local steps and averaging."""
    m = start(s)
    for number in range(rounds):
        shared = made.sparkSession.sparkContext.broadcast((flat(m), s))

        def run(batches: Iterator[pa.RecordBatch], number=number, shared=shared) -> Iterator[pa.RecordBatch]:
            weights, s = shared.value
            learned, n, part = unflat(weights.astype(np.float32)), 0, TaskContext.get().partitionId()
            for b in batches:
                for row in b.to_pylist():
                    stream = Stream(row["tokens"], row["sizes"], row["sub_n"], row["sub"])
                    rows, targets, scored = stream.lessons(row["held"], number, rounds, s)
                    if len(rows):
                        learned = learn(learned, s, rows, targets, scored.astype(np.float32), rate / (1 + number), part)
                        n += len(rows)
            if n:
                yield batch(_WEIGHTS, [part], [n], [flat(learned).astype(np.float32).tobytes()])

        local = _inputs(made).mapInArrow(run, "part long, windows long, weights binary")
        found = _tree(local, average, "part long, windows long, weights binary", made.rdd.getNumPartitions(), 4 * len(flat(m)))
        if found is None:
            break
        m = unflat(np.frombuffer(found["weights"], np.float32).copy())
    return m


def score(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row."""
    spark = docs.sparkSession
    tokens = segmenter(read_ranks(ranks_path), pattern).tokens
    made = blocks(docs, ranks_path, pattern)
    counts = word_counts(made)
    # one row a subword: at most the vocabulary
    seen = made.select(F.explode(F.arrays_zip("sub_ids", "sub_counts")).alias("x")).groupBy(F.col("x.sub_ids").alias("i")).agg(F.sum("x.sub_counts").alias("n")).collect()
    frequency = np.zeros(len(tokens) + 1)
    for r in seen:
        frequency[r["i"]] = r["n"]
    order = frequent(frequency)
    s = shape(frequency, tokens, order, alike(company(made, order)))
    words = counts.agg(F.sum("n_words"), F.sum("n_train")).first()
    train_docs = made.agg(F.sum("train_docs")).first()[0] or 0
    n_train, n_words = (words[1] or 0) + train_docs, (words[0] or 0) + (train_docs > 0)
    shared = spark.sparkContext.broadcast((train(made, s), s))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        m, s = shared.value
        if not block.num_rows:
            return schema.empty_table()
        row = {name: block.column(name)[0].as_py() for name in ("doc_ids", "held", "sizes", "tokens", "sub_n", "sub")}
        stream = Stream(row["tokens"], row["sizes"], row["sub_n"], row["sub"])
        own = found.column("c").take(pa.array(np.argsort(found.column("part").to_numpy())))
        c = np.concatenate(([train_docs], np.frombuffer(_joined(own), "<i8")))
        doc = np.repeat(np.arange(len(stream.sizes)), stream.sizes)
        base = np.bincount(doc, np.log10(c + 1.0)[stream.tokens], len(stream.sizes)) - stream.sizes * math.log10(n_train + n_words + 1)
        known = np.bincount(doc, (c > 0)[stream.tokens], len(stream.sizes)).astype(np.int64)
        return pa.Table.from_batches([batch(schema, row["doc_ids"], row["held"], stream.sizes, known, [n_train] * len(known), base, stream.scores(m, s))])

    # every block's words come back to it: the join is on the block, and its words bound what it gets
    own = made.select("block", "doc_ids", "held", "sizes", "tokens", "sub_n", "sub").groupBy("block")
    return own.cogroup(counts.select("block", "part", "c").groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

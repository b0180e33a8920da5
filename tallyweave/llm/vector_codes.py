"""Vector code compression: product quantisation whose codebooks are learned by Lloyd's rounds over heaps.

Vectors of integers are cut into parts; the codebook of each part has an entry per code. A round assigns every part to its nearest entry, then moves
each entry to the floor of its parts' mean. What a round needs to know of a part is its slack: how much nearer the best entry is
than the second, in distances, not squares. As long as the best entry's own move and the largest move of any other, summed over rounds (the drift), stay below it,
the part can't change. So each block of vectors keeps a heap per entry, keyed by the slack plus the drift at the time of the scan; a round
pops only the parts whose key the drift has reached and scans these exactly. Ties have no slack and are scanned each time.

A block, with its integers, codes and heaps, is a row of a written table; a round reads the blocks, writes them anew and frees the last
table, so a lost executor costs the blocks of its tasks. Vectors are never shuffled: tasks add up integers per entry, and the sums are
added up by part and position. Codebooks, as many numbers as entries times dimensions, pass through the driver.

Defined cases: rows whose vector is null or empty, or holds null or non-finite components, are dropped; so are vectors of another length than
the most frequent one (of equally frequent ones the longest). A length that can't be divided is filled up with zeros. Components
beyond 32,768 in size are cut to it, which keeps all sums exact in 64 bits; sums of errors stop at the largest long. Fewer kept vectors
than entries give as many entries. A null vec_id comes last and repeated ids are ordered by their components; all rows are returned. Null labels count as one label.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bound_batches, join_counted, materialize, release

PARTS, ENTRIES, ROUNDS, SCALE, MOST = 4, 256, 4, 1024, 1 << 25
BLOCK_ROWS = 8192
_BLOCK, _SUMS = 0, 1
_STATE = pa.schema([
    ("kind", pa.int8()), ("part", pa.int32()), ("numbers", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("ints", pa.binary()),
    ("codes", pa.binary()), ("keys", pa.binary()), ("order", pa.binary()), ("sizes", pa.binary()),
])
_STATE_DDL = "kind tinyint, part int, numbers array<long>, ids array<long>, labels array<long>, ints binary, codes binary, keys binary, order binary, sizes binary"


def kept(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label, v (integers) of the rows that count, and the length of v, a multiple of ``parts``; 0 if there are none."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cut = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(whole)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), cut.alias("v"))
    length = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not length:
        return rows, 0
    size = length[0]["size"]
    fill = -size % parts
    rows = rows.where(F.size("v") == size)
    return (rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), fill))) if fill else rows), size + fill


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                kind = "<i2" if -32768 <= v.min() and v.max() < 32768 else "<i4"
                yield batch(_STATE, [_BLOCK], [0], [[]], pa.array([part.column(0).to_pylist()], _STATE.field(3).type), pa.array([part.column(1).to_pylist()], _STATE.field(4).type), [v.astype(kind).tobytes()], [b""], [b""], [b""], [b""])

    bound_batches(rows.sparkSession)
    return rows.select("vec_id", "label", "v").mapInArrow(run, _STATE_DDL)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower index of equal ones, and by how much it's nearer than the next."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # all sums are whole numbers that doubles hold
        y, c = x.astype(np.float64), book.astype(np.float64)
        far = (y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)
    else:
        far = np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)
    best, rows = far.argmin(1), np.arange(len(x))
    upper = np.sqrt(far[rows, best].astype(np.float64))
    if len(book) == 1:
        return best, np.full(len(x), np.inf)
    far[rows, best] = np.iinfo(np.int64).max if far.dtype == np.int64 else np.inf
    return best, np.sqrt(far.min(1).astype(np.float64)) - upper


class Heaps:
    """Of one block and part: a heap of (key, row) for each entry; read from arrays only where it's touched."""

    def __init__(self, n_entries: int, keys: np.ndarray, order: np.ndarray, sizes: np.ndarray):
        self.keys, self.order = keys, order
        self.start = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64) if len(sizes) else np.zeros(n_entries + 1, np.int64)
        self.open: dict[int, list[tuple[float, int]]] = {}

    def heap(self, entry: int) -> list[tuple[float, int]]:
        if entry not in self.open:
            span = slice(self.start[entry], self.start[entry + 1])
            self.open[entry] = list(zip(self.keys[span].tolist(), self.order[span].tolist()))
        return self.open[entry]

    def pop(self, limits: np.ndarray) -> list[int]:
        """The rows whose key isn't above their entry's limit."""
        some = np.flatnonzero(self.start[1:] > self.start[:-1])
        out = []
        for entry in some[self.keys[self.start[some]] <= limits[some]].tolist():
            heap, limit = self.heap(entry), limits[entry]
            while heap and heap[0][0] <= limit:
                out.append(heappop(heap)[1])
        return out

    def push(self, entries: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        at_once = not len(self.keys)
        for entry, key, row in zip(entries.tolist(), keys.tolist(), rows.tolist()):
            if at_once:
                self.heap(entry).append((key, row))
            else:
                heappush(self.heap(entry), (key, row))
        if at_once:
            for heap in self.open.values():
                heapify(heap)

    def arrays(self) -> tuple[bytes, bytes, bytes]:
        keys, order, sizes = [], [], np.diff(self.start).astype("<i4")
        for entry in range(len(sizes)):
            if entry in self.open:
                heap = self.open[entry]
                sizes[entry] = len(heap)
                keys.append(np.array([k for k, _ in heap], "<f8"))
                order.append(np.array([i for _, i in heap], "<i4"))
            else:
                span = slice(self.start[entry], self.start[entry + 1])
                keys.append(self.keys[span])
                order.append(self.order[span])
        return np.concatenate(keys).astype("<f8").tobytes(), np.concatenate(order).astype("<i4").tobytes(), sizes.tobytes()


def assign_block(ints: np.ndarray, codes: np.ndarray, heaps: list[Heaps], books: np.ndarray, drift: np.ndarray, first: bool) -> int:
    """Bring the codes of a block (rows x parts), and its heaps, up to the codebooks; how many parts were scanned."""
    width, scanned = books.shape[2], 0
    for p in range(len(books)):
        x = ints[:, p * width : (p + 1) * width]
        # distances are rounded in the last of some 15 digits: what lies as near as that to the limit is scanned too
        near = 1e-9 * (1 + drift[p] + float(max(np.abs(x).max(initial=0), np.abs(books[p]).max(initial=0))) * width)
        rows = np.arange(len(x)) if first else np.array(heaps[p].pop(drift[p] + near), np.int64)
        if len(rows):
            best, slack = nearest(x[rows], books[p])
            codes[rows, p] = best
            heaps[p].push(best, slack + drift[p][best], rows)
        scanned += len(rows)
    return scanned


def _opened(b: pa.RecordBatch, i: int, n_parts: int, n_entries: int, width: int) -> tuple[np.ndarray, np.ndarray, list[Heaps]]:
    cell = {name: b.column(b.schema.get_field_index(name))[i].as_py() for name in ("ints", "codes", "keys", "order", "sizes")}
    n = len(b.column(b.schema.get_field_index("ids"))[i])
    ints = np.frombuffer(cell["ints"], "<i2" if len(cell["ints"]) == 2 * n * n_parts * width else "<i4").reshape(n, n_parts * width).astype(np.int64)
    codes = np.frombuffer(cell["codes"], np.uint8).reshape(-1, n_parts).copy() if cell["codes"] else np.zeros((n, n_parts), np.uint8)
    keys, order, sizes = np.frombuffer(cell["keys"], "<f8"), np.frombuffer(cell["order"], "<i4"), np.frombuffer(cell["sizes"], "<i4")
    if not len(sizes):
        return ints, codes, [Heaps(n_entries, keys, order, sizes) for _ in range(n_parts)]
    return ints, codes, [Heaps(n_entries, keys[p * n : (p + 1) * n], order[p * n : (p + 1) * n], sizes[p * n_entries : (p + 1) * n_entries]) for p in range(n_parts)]


def _round(state: DataFrame, books: np.ndarray, drift: np.ndarray, first: bool) -> DataFrame:
    """The blocks after a round, and each task's sums: a row for each part, of entries x width sums and then a count for each entry."""
    n_parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, any_block = np.zeros((n_parts, n_entries, width), np.int64), np.zeros((n_parts, n_entries), np.int64), False
        for b in batches:
            for i in range(b.num_rows):
                any_block = True
                ints, codes, heaps = _opened(b, i, n_parts, n_entries, width)
                assign_block(ints, codes, heaps, books, drift, first)
                for p in range(n_parts):
                    counts[p] += np.bincount(codes[:, p], minlength=n_entries)
                    for k in range(width):  # whole numbers far below 2 ** 53
                        sums[p, :, k] += np.bincount(codes[:, p], weights=ints[:, p * width + k], minlength=n_entries).astype(np.int64)
                keys, order, sizes = zip(*(h.arrays() for h in heaps))
                row = b.slice(i, 1)
                yield batch(_STATE, *[row.column(j) for j in range(6)], [codes.tobytes()], [b"".join(keys)], [b"".join(order)], [b"".join(sizes)])
        if any_block:
            for p in range(n_parts):
                yield batch(_STATE, [_SUMS], [p], [np.concatenate((sums[p].reshape(-1), counts[p]))], [[]], [[]], [b""], [b""], [b""], [b""], [b""])

    return state.mapInArrow(run, _STATE_DDL)


def _coded(state: DataFrame, books: np.ndarray, drift: np.ndarray, first: bool) -> DataFrame:
    n_parts, n_entries, width = books.shape
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ints, codes, heaps = _opened(b, i, n_parts, n_entries, width)
                assign_block(ints, codes, heaps, books, drift, first)
                chosen = np.concatenate([books[p][codes[:, p]] for p in range(n_parts)], 1)
                hexed = codes.tobytes().hex()
                step = 2 * n_parts
                text = [hexed[at : at + step] for at in range(0, len(hexed), step)]
                yield batch(schema, b.column(3)[i].values, b.column(4)[i].values, text, ((ints - chosen) ** 2).sum(1))

    return state.mapInArrow(run, "vec_id long, label long, code string, error long")


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray, np.ndarray, bool]:
    """The blocks after all rounds, the final codebooks (parts x entries x width), the drift that the blocks haven't seen yet, and whether no round was made."""
    rows, size = kept(vectors, parts)
    if not size:
        return None, np.zeros((parts, 0, 0), np.int64), np.zeros((parts, 0)), True
    width = size // parts
    state = materialize(_blocks(rows, size), "blocks")
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # as many as entries: bounded
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    drift = np.zeros(books.shape[:2])
    for r in range(rounds):
        after = materialize(_round(state.where(F.col("kind") == _BLOCK), books, drift, r == 0), "blocks")
        release(state)
        state = after
        each = state.where(F.col("kind") == _SUMS).select("part", F.posexplode("numbers").alias("at", "number"))
        # parts x entries x (width + 1) numbers
        t = each.groupBy("part", "at").agg(F.sum("number").alias("number")).toArrow()
        total = np.zeros((parts, books.shape[1] * (width + 1)), np.int64)
        total[t.column("part").to_numpy(), t.column("at").to_numpy()] = t.column("number").to_numpy()
        sums, counts = total[:, : -books.shape[1]].reshape(books.shape), total[:, -books.shape[1] :]
        moved = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        moves = np.sqrt(((moved - books) ** 2).sum(2).astype(np.float64))
        books = moved
        for p in range(parts):
            ranked = np.sort(moves[p])[::-1]
            others = np.where(moves[p] == ranked[0], ranked[min(1, len(ranked) - 1)], ranked[0]) if len(ranked) > 1 else np.zeros(1)
            if (moves[p] == ranked[0]).sum() > 1:
                others = np.full(len(ranked), ranked[0])
            drift[p] += moves[p] + others
    return state, books, drift, rounds == 0


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept vector."""
    state, books, drift, first = learn(vectors, parts, entries, rounds)
    if state is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(_coded(state.where(F.col("kind") == _BLOCK), books, drift, first), "codes")
    release(state)
    # a null label is a label like others, below all longs that a label has
    keyed = coded.withColumn("key", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label")))
    error = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    totals = keyed.groupBy("key").agg(F.count("*").alias("n"), error.alias("label_error"))
    return join_counted(keyed, totals, "key", coded.count()).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))

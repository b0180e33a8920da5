"""Fill-in-middle transformation: texts cut into prefix, middle and suffix at unit boundaries, and put in another order.

A unit is a run of ASCII letters or any other single code point. A table over (state, class of byte) reads the UTF-8 bytes of many
texts in one scan: its states know how many continuation bytes are awaited, whether a run of letters is open and how much of a sentinel
``<P>``, ``<S>`` or ``<M>`` has been seen, and each transition says what it adds to the counts: a unit, a code point, a sentinel. A
state depends on the last four bytes at most, so the bytes of a batch are scanned in many lanes side by side, each begun four bytes early. The counts
are kept for blocks of BLOCK bytes; a second pass goes to the blocks of the cuts only and finds their bytes. There is no shuffle.

Where the cuts lie, and which form a text takes, follows from a hash of the seed and its doc_id, so reruns agree.

Defined cases: null and empty texts are plain, with no units. A null doc_id is hashed as the empty text. Rows that share a doc_id take the same hashes.
Texts may be of any length; a batch holds at least one whole text. A text with a sentinel stays plain. An empty table gives an
empty result. Columns other than doc_id and text are ignored, whatever their names. Bytes that aren't UTF-8 count as a code point each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, blobs, by_size, doc_rows

#: What stands before each part in the output, in the contract's notation.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, TRANSFORMED, SUFFIX_FIRST = 1, 90, 20

UNIT, POINT, SENTINEL = 1, 2, 4
_CLASSES = 16
_LETTER, _MARK, _LESS, _MORE, _OTHER, _TAIL, _LEAD2, _LEAD3, _LEAD4, _GAP = range(10)
_REST, _WORD, _AWAIT1, _AWAIT2, _AWAIT3, _OPENED, _MARKED = range(7)
#: Stands between texts in a batch; no byte of UTF-8.
_BETWEEN = b"\xff"
WARM, LANES, BLOCK = 4, 8192, 256


def _class(byte: int) -> int:
    if byte in PREFIX[1:2] + SUFFIX[1:2] + MIDDLE[1:2]:
        return _MARK
    if chr(byte).isalpha() and byte < 0x80:
        return _LETTER
    if byte < 0x80:
        return {ord("<"): _LESS, ord(">"): _MORE}.get(byte, _OTHER)
    if byte < 0xC0:
        return _TAIL
    return _LEAD2 if byte < 0xE0 else _LEAD3 if byte < 0xF0 else _LEAD4 if byte < 0xF8 else _GAP


def _tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """The class of each byte, and for state * _CLASSES + class: the next state (times _CLASSES), and what is counted."""
    after, adds = np.zeros(7 * _CLASSES, np.uint8), np.zeros(7 * _CLASSES, np.uint8)
    for state in range(7):
        for kind in range(10):
            in_word = state in (_WORD, _MARKED)
            to, add = _REST, UNIT | POINT
            if kind in (_LETTER, _MARK):
                to = _MARKED if state == _OPENED and kind == _MARK else _WORD
                add = POINT if in_word else UNIT | POINT
            elif kind == _LESS:
                to = _OPENED
            elif kind == _MORE and state == _MARKED:
                add |= SENTINEL
            elif kind == _TAIL and state in (_AWAIT1, _AWAIT2, _AWAIT3):
                to, add = {_AWAIT1: _REST, _AWAIT2: _AWAIT1, _AWAIT3: _AWAIT2}[state], 0
            elif kind in (_LEAD2, _LEAD3, _LEAD4):
                to = {_LEAD2: _AWAIT1, _LEAD3: _AWAIT2, _LEAD4: _AWAIT3}[kind]
            elif kind == _GAP:
                add = 0
            after[state * _CLASSES + kind], adds[state * _CLASSES + kind] = to * _CLASSES, add
    return bytes(_class(b) for b in range(256)), after, adds


_CLASS_OF, _AFTER, _ADDS = _tables()


def scan(joined: bytes) -> np.ndarray:
    """What the transition at each byte adds; texts are joined by ``_BETWEEN``."""
    kinds = np.frombuffer(joined.translate(_CLASS_OF), np.uint8)
    lanes = max(1, min(LANES, len(kinds) // 64))
    steps = max(WARM, -(-len(kinds) // lanes))
    filled = np.full(lanes * steps, _GAP, np.uint8)
    filled[: len(kinds)] = kinds
    columns = np.ascontiguousarray(filled.reshape(lanes, steps).T)
    state = np.zeros(lanes, np.uint8)
    for j in range(steps - WARM, steps):
        state[1:] = _AFTER[state[1:] + columns[j, :-1]]
    out = np.empty_like(columns)
    for j in range(steps):
        at = state + columns[j]
        out[j] = _ADDS[at]
        state = _AFTER[at]
    return out.T.reshape(-1)[: len(kinds)]


class Counts:
    """How many transitions before any byte had a mark, and where the n-th is: sums of blocks, and a look into one block."""

    def __init__(self, marked: np.ndarray):
        self.blocks = np.zeros((len(marked) // BLOCK + 1, BLOCK), np.uint8)
        self.blocks.reshape(-1)[: len(marked)] = marked
        self.upto = np.concatenate(([0], np.cumsum(self.blocks.sum(1, dtype=np.int64))))

    def before(self, at: np.ndarray) -> np.ndarray:
        block, inside = np.divmod(at, BLOCK)
        seen = np.concatenate((np.zeros((len(at), 1), np.int64), np.cumsum(self.blocks[block], 1, dtype=np.int64)), 1)
        return self.upto[block] + seen[np.arange(len(at)), inside]

    def place(self, n: np.ndarray) -> np.ndarray:
        """The byte of transition n, counted from 0; the blocks' end if there is none."""
        block = np.minimum(np.searchsorted(self.upto, n, "right") - 1, len(self.blocks) - 1)
        left = n - self.upto[block]
        return block * BLOCK + (np.cumsum(self.blocks[block], 1, dtype=np.int64) <= left[:, None]).sum(1)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def arrange(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "plain":
        return prefix + middle + suffix
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of: its parts hold no sentinel, so the first of each is the one that was put in."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, middle = output[len(first) :].partition(MIDDLE)
    one, _, other = head.partition(second)
    return one + middle + other if form == "psm" else other + middle + one


def transform(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, keep_output: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output (binary; null unless asked for).

    ``transformed`` of 100 texts are cut; ``suffix_first`` of 100 of these put the suffix first (spm), the others the prefix (psm).
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
        ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("output", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 1, 8 << 20):
                ids, bodies = part.column(0).to_pylist(), blobs(part.column(1))
                starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in bodies])))[:-1]
                ends = starts + [len(x) for x in bodies]
                found = scan(_BETWEEN.join(bodies))
                units, points, marks = (Counts(found & bit != 0) for bit in (UNIT, POINT, SENTINEL))
                first = units.before(starts)
                n = units.before(ends) - first
                marked = marks.before(ends) > marks.before(starts)
                drawn = [draws(i, seed) for i in ids]
                h = np.array(drawn, np.int64).reshape(-1, 4)
                low, high = np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))
                cuts = [np.where(k == n, ends, units.place(first + k)) for k in (low, high)]
                chars = [points.before(at) for at in (starts, *cuts)]
                plain = (n == 0) | marked | (h[:, 2] % 100 >= transformed)
                forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < suffix_first, "spm", "psm")).tolist()
                outputs, restored = [], []
                for body, form, start, one, two in zip(bodies, forms, starts.tolist(), cuts[0].tolist(), cuts[1].tolist()):
                    out = arrange(form, body[: one - start], body[one - start : two - start], body[two - start :])
                    outputs.append(out)
                    restored.append(hashlib.sha256(restore(out, form)).hexdigest())
                yield batch(
                    schema, part.column(0), n, forms, pa.array(chars[1] - chars[0], mask=plain), pa.array(chars[2] - chars[1], mask=plain),
                    [hashlib.sha256(o).hexdigest() for o in outputs], restored, outputs if keep_output else pa.nulls(len(ids), pa.binary()),
                )

    columns = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output binary"
    return doc_rows(docs).mapInArrow(run, columns)

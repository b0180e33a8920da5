"""Hashed word and character n-grams of many texts at once.

Features are words, pairs of neighbouring words, and runs of four characters (code points), each hashed to one of ``BUCKETS``. Pairs of
a word with itself are one feature, as most words' own such pair is too rare to be learned from (README has what it changes). A
document's value of a feature is its share among the document's word features, or among its runs.
Texts are handled in blocks of about ``BLOCK`` bytes, so memory doesn't depend on their length. A longer text is cut before white space,
never inside a word, and what spans a cut is counted as a part of its own: the pair of words around it, and the runs that cross it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .common import WHITE

BUCKETS_LOG2 = 17
BUCKETS = 1 << BUCKETS_LOG2
BLOCK = 1 << 18
RUN = 4
SCALE = 64.0  # shares are small; weights are of a share times this

#: What a part of a block is good for.
WHOLE, PAIR_ONLY, RUNS_ONLY = 0, 1, 2

_P = np.uint64(0x100000001B3)
_TWICE = np.uint64(0x5851F42D4C957F2D)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []
_IS_WHITE = np.zeros(128, bool)
_IS_WHITE[list(WHITE)] = True
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of _P and of its inverse, modulo 2^64; more are made for a word longer than a block."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_P, np.uint64(pow(int(_P), -1, 1 << 64))):
            steps = np.full(max(n, 2 * BLOCK), base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        if n > 4 * BLOCK:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def _cut(body: bytes) -> Iterator[tuple[int, bytes]]:
    """A text's parts of about BLOCK bytes, with what each is good for."""
    at, last = 0, b""
    while at < len(body):
        end = len(body)
        if end - at > BLOCK:
            end = max(body.rfind(c, at + BLOCK // 2, at + BLOCK) for c in (b" ", b"\n", b"\t"))
            if end < 0:
                white = _WHITE.search(body, at + BLOCK)
                end = white.start() if white else len(body)
        if at:
            first = _WORD.search(body, at, end)
            if last and first:
                yield PAIR_ONLY, last + b" " + first[0]
            before, after = body[at - 4 * RUN : at].decode("utf-8", "ignore"), body[at : at + 4 * RUN].decode("utf-8", "ignore")
            yield RUNS_ONLY, (before[1 - RUN :] + after[: RUN - 1]).encode()
        yield WHOLE, body[at:end]
        if end < len(body):
            words = body[at:end].split()
            last = words[-1] if words else last
        at = end


def blocks(bodies: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Documents' numbers, uses and parts of texts, together about BLOCK bytes."""
    who, uses, parts, size = [], [], [], 0
    for i, body in enumerate(bodies):
        for use, part in _cut(body):
            if size and size + len(part) > BLOCK:
                yield who, uses, parts
                who, uses, parts, size = [], [], [], 0
            who.append(i)
            uses.append(use)
            parts.append(part)
            size += len(part)
    if who:
        yield who, uses, parts


def hashed(uses: list[int], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the word features, the part of each, buckets of the runs, and the part of each."""
    texts = [p.decode("utf-8", "replace") for p in parts]
    buf = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), "<u4")
    powers, inverse = _powers(len(buf) + 1)
    sizes, use = np.fromiter(map(len, texts), np.int64, len(texts)), np.array(uses)
    part_end = np.cumsum(sizes + 1)
    shift = np.uint64(64 - BUCKETS_LOG2)
    white = (buf < 128) & _IS_WHITE[np.minimum(buf, 127)]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf * powers[: len(buf)], out=total[1:])
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    word = (total[ends] - total[starts]) * inverse[starts] + np.uint64(1)
    part = np.searchsorted(part_end, starts, "right")
    pairs = np.flatnonzero((part[1:] == part[:-1]) & (use[part[1:]] != RUNS_ONLY))
    pair = word[pairs] * np.uint64(0xD6E8FEB86659FD93) + word[pairs + 1]
    pair[word[pairs] == word[pairs + 1]] = _TWICE
    single = use[part] == WHOLE
    words = ((np.concatenate((word[single], pair)) * _ODD) >> shift).astype(np.int64)
    word_part = np.concatenate((part[single], part[pairs]))
    runs, run_part = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(buf) >= RUN:
        wide, n = buf.astype(np.uint64), len(buf) - RUN + 1
        four = wide[:n]
        for k in range(1, RUN):
            four = four * _P + wide[k : k + n]
        four = (four * _ODD) >> shift
        run_part = np.repeat(np.arange(len(parts)), sizes + 1)[:n]
        inside = (np.arange(n) + RUN <= (part_end - 1)[run_part]) & (use[run_part] != PAIR_ONLY)
        runs, run_part = four[inside].astype(np.int64), run_part[inside]
    return words, word_part, runs, run_part


def sums(bodies: list[bytes], word_table: np.ndarray, run_table: np.ndarray) -> np.ndarray:
    """For each text the mean of word_table over its word features plus the mean of run_table over its runs."""
    found = np.zeros((len(bodies), 4))
    for who, uses, parts in blocks(bodies):
        words, word_part, runs, run_part = hashed(uses, parts)
        n = len(parts)
        block = np.stack(
            [
                np.bincount(word_part, word_table[words], n), np.bincount(word_part, minlength=n),
                np.bincount(run_part, run_table[runs], n), np.bincount(run_part, minlength=n),
            ], axis=1,
        )
        np.add.at(found, who, block)
    return (found[:, 0] / np.maximum(found[:, 1], 1) + found[:, 2] / np.maximum(found[:, 3], 1)) * SCALE


def sparse(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of one text, runs after the word features, and their scaled shares."""
    counts = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)] if len(body) > BLOCK else None
    ids, n = [], [0, 0]
    for _, uses, parts in blocks([body]):
        words, _, runs, _ = hashed(uses, parts)
        for k, found in enumerate((words, runs)):
            n[k] += len(found)
            if counts is None:
                ids.append(found + k * BUCKETS)
            else:
                counts[k] += np.bincount(found, minlength=BUCKETS)
    if counts is not None:
        both = np.concatenate(counts)
        i = np.flatnonzero(both)
        c = both[i]
    elif ids:
        i, c = np.unique(np.concatenate(ids), return_counts=True)
    else:
        return np.zeros(0, np.int64), np.zeros(0)
    return i, c * SCALE / np.where(i < BUCKETS, max(n[0], 1), max(n[1], 1))

"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can end its encoding. The table of these last tokens
is all an encoder needs: following it backwards gives the ids, appending extends the table, and an
edit recomputes it from the touched piece on until the pieces agree with the old ones again.

A token may follow another if the merges inside both, run in rank order, never find a better merge
across the border between them.

Defined cases: null and empty texts give no ids, and the hash of no bytes. Repeated rows and ids are
encoded row by row, a null doc_id stays null, an empty table gives no rows. Very long texts go alone, whole, and pieces of any length are encoded.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch, blobs, by_size, doc_rows

#: Bound on the words, pieces and token pairs that a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 200_000
#: Texts encoded at once, in bytes; a longer text goes alone.
AT_ONCE = 2 << 20
_NEVER = 1 << 40
#: Longer pieces, in bytes, get a table of their own.
_WIDEST = 48
_SLOTS = 1 << 20


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


class Vocabulary:
    """Ranks of a tiktoken file, and what the prefix table needs of them."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.tokens))
        self.pattern = regex.compile(pattern)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._tails: dict[int, list[int]] = {}
        self._heads: dict[int, list[int]] = {}
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[bytes, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._tree = self._table = None
        self._sizes = np.array([len(t) for t in self.tokens])

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a single byte."""
        if token not in self._parts:
            word = self.tokens[token]
            have = [word[i : i + 1] for i in range(len(word))]
            while len(have) > 2:
                ranked = [(self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(have, have[1:]))]
                rank, at = min(ranked)
                if rank >= token:
                    raise ValueError(f"token {token} can't be reached by merges")
                have[at : at + 2] = [have[at] + have[at + 1]]
            self._parts[token] = (self.ranks[have[0]], self.ranks[have[1]]) if len(have) == 2 else None
        return self._parts[token]

    def _spine(self, token: int, side: int, known: dict[int, list[int]]) -> list[int]:
        """From the outermost byte up to the token: all that stood at that border, in order of merging."""
        if token not in known:
            parts = self.parts(token)
            known[token] = [token] if parts is None else [*self._spine(parts[side], side, known), token]
        return known[token]

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            found = self._pairs[key] = self._border_holds(left, right)
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        tails, heads = self._spine(left, 1, self._tails), self._spine(right, 0, self._heads)
        i = j = 0
        while True:
            up_left = tails[i + 1] if i + 1 < len(tails) else _NEVER
            up_right = heads[j + 1] if j + 1 < len(heads) else _NEVER
            across = self.ranks.get(self.tokens[tails[i]] + self.tokens[heads[j]], _NEVER)
            if across < up_left and across <= up_right:  # of equal ranks the leftmost pair merges first
                return False
            if up_left == up_right == _NEVER:
                return True
            if up_left <= up_right:
                i += 1
            else:
                j += 1

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (entry 0 unused) up to the length of the piece; entries that it has stay."""
        ranks, pairs, longest = self.ranks, self._pairs, self.longest
        for end in range(len(last), len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(piece[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start]
                    fits = pairs.get(before << 32 | token)
                    if fits is None:
                        fits = self.may_follow(before, token)
                    if not fits:
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def walk(self, last: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at > 0:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def _steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens' tree of bytes as an open hash table: (node, byte) to node; and the token of each node."""
        if self._tree is None:
            edges: dict[int, int] = {}
            token_of = [-1]
            for rank, token in enumerate(self.tokens):
                node = 0
                for byte in token:
                    key = node << 8 | byte
                    node = edges.get(key, 0)
                    if not node:
                        node = edges[key] = len(token_of)
                        token_of.append(-1)
                token_of[node] = rank
            keys, to = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
            wanted = np.fromiter(edges.keys(), np.uint64, len(edges)) + np.uint64(1)
            for key, slot, node in zip(wanted.tolist(), _slot(wanted).tolist(), edges.values()):
                while keys[slot]:
                    slot = (slot + 1) % _SLOTS
                keys[slot], to[slot] = key, node
            self._tree = keys, to, np.array(token_of, np.int32)
        return self._tree

    def _fits(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``may_follow`` for many pairs: a direct-mapped table in front of the remembered pairs."""
        if self._table is None:
            self._table = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, bool)
        keys, values = self._table
        pair = (before.astype(np.uint64) << np.uint64(32) | tokens.astype(np.uint64)) + np.uint64(1)
        slot = _slot(pair)
        out, unknown = values[slot], keys[slot] != pair
        if unknown.any():
            asked, where = np.unique(pair[unknown], return_inverse=True)
            answers = np.array([self.may_follow(k - 1 >> 32, k - 1 & 0xFFFFFFFF) for k in asked.tolist()])
            slots = _slot(asked)
            keys[slots], values[slots] = asked, answers
            wrong = keys[slots] != asked  # two asked pairs in one slot: the later one is kept, with its own answer
            if wrong.any():
                of = dict(zip(asked.tolist(), answers.tolist()))
                values[slots] = [of[k] for k in keys[slots].tolist()]
            out[unknown] = answers[where]
        return out

    def extend_all(self, pieces: list[bytes]) -> list[bytes]:
        """The prefix tables of pieces of like length side by side, a column for each length; then their ids."""
        keys, to, token_of = self._steps()
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        text = np.frombuffer(b"".join(p.ljust(width + 1, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width + 1)
        last = np.full((len(pieces), width + 1), -1, np.int32)
        for start in range(width):
            rows = np.flatnonzero(lengths > start)
            nodes = np.zeros(len(rows), np.uint64)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                alive = lengths[rows] >= end
                rows, nodes = rows[alive], nodes[alive]
                key = (nodes << np.uint64(8) | text[rows, end - 1].astype(np.uint64)) + np.uint64(1)
                slot = _slot(key)
                found = np.zeros(len(rows), np.int64)
                ask = np.arange(len(rows))
                while len(ask):
                    have = keys[slot[ask]]
                    hit = have == key[ask]
                    found[ask[hit]] = to[slot[ask[hit]]]
                    ask = ask[~hit & (have != 0)]
                    slot[ask] = (slot[ask] + 1) % _SLOTS
                alive = found > 0
                rows, nodes = rows[alive], found[alive].astype(np.uint64)
                if not len(rows):
                    break
                tokens = token_of[found[alive]]
                ends = np.flatnonzero(tokens >= 0)
                if start:
                    ends = ends[last[rows[ends], end] < 0]
                    ends = ends[self._fits(last[rows[ends], start], tokens[ends])]
                last[rows[ends], end] = tokens[ends]
        if (last[np.arange(len(pieces)), lengths] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        sizes = self._sizes
        at, ids, counts = lengths.copy(), np.zeros((len(pieces), width), "<u4"), np.zeros(len(pieces), np.int64)
        rows = np.arange(len(pieces))
        while len(rows):
            token = last[rows, at[rows]]
            counts[rows] += 1
            ids[rows, width - counts[rows]] = token
            at[rows] -= sizes[token]
            rows = rows[at[rows] > 0]
        flat, end = ids.tobytes(), 4 * width
        return [flat[(i + 1) * end - 4 * n : (i + 1) * end] for i, n in enumerate(counts.tolist())]

    def _learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Ids of all these pieces; new ones are computed, those of like length at once."""
        known = self._pieces
        out = {p: known[p] for p in pieces if p in known}
        new = sorted((p for p in pieces if p not in known), key=len)
        tabled = []
        for p in new:
            whole = self.ranks.get(p)
            if whole is not None:
                out[p] = np.array([whole], "<u4").tobytes()
            elif len(p) > _WIDEST:
                out[p] = np.array(self.walk(self.extend(p, [-1])), "<u4").tobytes()
            else:
                tabled.append(p)
        for at in range(0, len(tabled), 10_000):
            some = tabled[at : at + 10_000]
            out.update(zip(some, self.extend_all(some)))
        if len(known) + len(new) > REMEMBERED // 2:
            known.clear()
        known.update((p, out[p]) for p in new if len(p) <= _WIDEST)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain: list[list[str] | None] = [None if _ODD_SPACE.search(t) else t.split(" ") for t in texts]
        other = [[p.encode() for p in self.pattern.findall(t if words is None else words[0])] for t, words in zip(texts, plain)]
        new: set[str] = set()
        for words in plain:
            if words is not None:
                new.update(words[1:])
        ids = self._learn_words(new, [p for pieces in other for p in pieces])
        starts = [b"".join(map(ids.__getitem__, pieces)) for pieces in other]
        known = self._words.__getitem__
        return [s if words is None else s + b"".join(map(known, words[1:])) for s, words in zip(starts, plain)]

    def _learn_words(self, words: set[str], pieces: list[bytes] = ()) -> dict[bytes, bytes]:
        """Remember ids of all these words, each after one space; the ids of ``pieces`` and of the new words' pieces."""
        if len(self._words) + len(words) > REMEMBERED:
            self._words.clear()
        # the pattern always starts a match at a space before a word
        split = {w: [p.encode() for p in self.pattern.findall(" " + w)] for w in words - self._words.keys()}
        ids = self._learn({p for own in (pieces, *split.values()) for p in own})
        for w, own in split.items():
            self._words[w] = b"".join([ids[p] for p in own])
        return ids

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word as it stands after one space."""
        self._learn_words(set(words))
        return list(map(self._words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: A space that doesn't begin a word: before white space or at the end.
_ODD_SPACE = re.compile(r" (?:\s|$|[\x1c-\x1f])")


class PrefixTable:
    """A text with the last token of every prefix of its pieces; appends and edits keep it exact."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text, self.pieces = vocabulary, "", []
        self.recomputed = 0  # pieces computed by the last change
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of text[start:end]; only pieces near the edit are computed again."""
        v, old = self.vocabulary, self.pieces  # of (start, text, last)
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        keep = 0
        while keep < len(old) and old[keep][0] + len(old[keep][1]) < start:
            keep += 1
        keep = max(0, keep - 1)  # white space looks one character ahead
        fresh, later, self.recomputed = [], {p[0] + shift: i for i, p in enumerate(old) if p[0] > end}, 0
        tail: list = []
        for m in v.pattern.finditer(self.text, old[keep][0] if keep < len(old) else 0):
            i = later.get(m.start())
            if i is not None and m.start() > start + len(new) and old[i][1] == m.group():
                tail = [(a + shift, t, last) for a, t, last in old[i:]]
                break
            had = old[keep + len(fresh)] if keep + len(fresh) < len(old) else None
            last = [-1]
            if had and m.group().startswith(had[1]) and had[0] == m.start():  # the piece grew: go on from its table
                last = had[2][:]
            fresh.append((m.start(), m.group(), v.extend(m.group().encode(), last)))
            self.recomputed += 1
        self.pieces = old[:keep] + fresh + tail

    def ids(self) -> list[int]:
        out = []
        for _, piece, last in self.pieces:
            whole = self.vocabulary.ranks.get(piece.encode())
            out += self.vocabulary.walk(last) if whole is None else [whole]
        return out


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    """One vocabulary for each Python worker and file."""
    key = hashlib.sha256(raw + pattern.encode()).digest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(raw, pattern)
    return _LOADED[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Ids and decoded text of every document: doc_id, n_tokens, ids (binary), decoded (binary) and their sha256.

    No shuffle: one pass over the texts. The rank file, about a megabyte whatever the corpus, is broadcast.
    """
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [("ids", pa.binary()), ("decoded", pa.binary())]
        ddl += ", ids binary, decoded binary"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value, pattern)
        for b in batches:
            for part in by_size(b, 1, AT_ONCE):
                bodies = blobs(part.column(1))
                out = v.encode_all([body.decode("utf-8", "replace") for body in bodies])
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), out):
                    decoded = v.decode(ids)
                    row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append(row + (ids, decoded) if keep_ids else row)
                yield batch(schema, *zip(*rows))

    return doc_rows(docs).mapInArrow(run, ddl)

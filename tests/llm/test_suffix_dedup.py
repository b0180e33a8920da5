from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import suffix_dedup as sd

from .rows import documents, empty


def plain_reading(rows, length=50):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by a dictionary of all strings."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, body in rows:
        rank = (i is not None, i or 0)
        for at in range(len(body) - length + 1):
            s = body[at : at + length]
            least[s] = min(least.get(s, rank), rank)
    out = Counter()
    for i, body in rows:
        gone = bytearray(len(body))
        for at in range(len(body) - length + 1):
            if least[body[at : at + length]] < (i is not None, i or 0):
                gone[at : at + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(body)))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out[i, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(15) for _ in range(5)] + ["z" * 120, "ab" * 60, "é" * 40, "x" * 49, "y" * 50, "q" * 51]
    copy = prose(60)
    out = []
    for i in range(n):
        t = prose(rng.randint(0, 80))
        if rng.random() < 0.5:
            t = prose(rng.randint(0, 9)) + rng.choice(passages) + rng.choice(["", " "]) + t + rng.choice(["", rng.choice(passages)])
        if i % 3 == 0:  # near copies of one text, a third of all
            at = rng.randint(0, len(copy))
            t = copy[:at] + rng.choice(words) + copy[at:] if rng.random() < 0.7 else copy
        out.append((rng.randint(0, 400), t))
    return out + [(500, "z" * 3000), (501, "z" * 200), (7, None), (8, ""), (9, "short"), (10, "w" * 400 + "v" * 400), (11, "w" * 300 + "v" * 100)]


@pytest.mark.parametrize("seed, parts, chunk", [(1, 1, 2 << 20), (2, 4, 2 << 20), (3, 3, 4000), (4, 2, 600), (5, 7, 20_000)])
def test_against_all_strings(spark, monkeypatch, seed, parts, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    monkeypatch.setattr(sd.spans, "__defaults__", (sd.LENGTH, chunk))
    monkeypatch.setattr(sd, "by_size", lambda b, column, most, whole=sd.by_size: whole(b, column, min(most, max(500, chunk // 3))))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        rows = corpus(seed)
        assert got(sd.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == plain_reading(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_rows(spark):
    docs = documents(spark)
    docs = docs.where("length(text) < 5000 or text is null")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    made = sd.dedup(docs)
    assert got(made) == plain_reading(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in made.collect())
    assert sd.dedup(empty(spark)).collect() == []
    assert sd.dedup(spark.createDataFrame([(1, "x")], "doc_id long, text string"), keep_text=False).collect()[0].kept is None


def test_other_lengths(spark):
    rows = corpus(8, 60)
    for length in (24, 80):
        assert got(sd.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length)) == plain_reading(rows, length)


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b", "c", "aaaa", "bb" * 20, "abc" * 30, "z" * 70, "\0"]) for _ in range(200)).encode()
    n = len(text)
    order = sd.two_stage(text, np.array([0]), np.array([n]), 50)
    assert sorted(order.tolist()) == list(range(n))
    keys = [text[p : p + 50] for p in order.tolist()]
    assert keys == sorted(keys)
    # only some suffixes asked for
    starts, counts, at = [], [], 0
    while at < n - 80:
        starts.append(at)
        counts.append(rng.randint(1, 20))
        at += counts[-1] + rng.randint(49, 60)
    order = sd.two_stage(text, np.array(starts), np.array(counts), 50)
    assert sorted(order.tolist()) == [s + k for s, c in zip(starts, counts) for k in range(c)]
    keys = [text[p : p + 50] for p in order.tolist()]
    assert keys == sorted(keys)


def test_pieces_hold_every_string_once():
    rng = random.Random(3)
    bodies = ["".join(rng.choice("ab ") for _ in range(rng.choice([0, 10, 49, 50, 51, 400]))).encode() for _ in range(50)]
    gram, text, start, n = sd.pieces(bodies)
    seen, by_string = set(), {}
    for g, t, s, k in zip(gram.tolist(), text.tolist(), start.tolist(), n.tolist()):
        for i in range(s, s + k):
            assert (t, i) not in seen
            seen.add((t, i))
            assert by_string.setdefault(bodies[t][i : i + 50], g) == g
    assert seen == {(t, i) for t, b in enumerate(bodies) for i in range(len(b) - 49)}

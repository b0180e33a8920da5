from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tallyweave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n int, code string, v int"


def plain_reading(rows, parts=4, entries=256, rounds=4):
    """Lloyd's rounds over whole tables of distances, in whole numbers."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    v = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, v[i]))
    v = np.array(v, np.int64).reshape(len(rows), parts, -1)
    books = v[order[:entries]].transpose(1, 0, 2).copy()

    def assign():
        far = np.stack([((v[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(parts)], 1)
        return far.argmin(2), far.min(2)

    for _ in range(rounds):
        codes, _far = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                members = v[codes[:, p] == e, p]
                if len(members):
                    books[p, e] = members.sum(0) // len(members)
    codes, far = assign()
    errors, by_label = far.sum(1).tolist(), {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = vc.codebooks_sha256(books)
    return sorted(("%d" % r[0] if r[0] is not None else "", bytes(c.astype(np.uint8)).hex(), e, by_label[r[2]], sha) for r, c, e in zip(rows, codes, errors))


def got(df):
    return sorted(("%d" % r[0] if r[0] is not None else "", *r[1:]) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def made(n, seed, size=16, ties=False):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(12)]
    draw = (lambda c: round(c * 4) / 256) if ties else (lambda c: float(np.float32(c + rng.gauss(0, 0.1))))
    return [(i * 3, [draw(c) for c in rng.choice(centres)], rng.choice([0, 1, 2, None]), "k", 1, "c", 2) for i in range(n)]


@pytest.mark.parametrize("n, entries, ties", [(900, 256, False), (500, 16, True), (40, 256, False), (1, 256, False), (300, 1, False)])
def test_against_whole_tables_of_distances(spark, monkeypatch, n, entries, ties):
    monkeypatch.setattr(vc, "BLOCK_ROWS", 100)
    rows = made(n, n, ties=ties)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(vc.compress(df, entries=entries)) == plain_reading(rows, entries=entries)


def test_awkward_rows(spark):
    rows = made(60, 9, size=8)
    odd = [(2, None), (5, []), (7, [0.5] * 7 + [None]), (8, [math.nan] + [0.0] * 7), (10, [math.inf] + [0.0] * 7)]
    rows += [(i, v, 1, "k", 1, "c", 2) for i, v in odd] + [rows[3], rows[3], (None, [0.25] * 8, None, None, None, None, None), (9, [0.5] * 8, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(vc.compress(df, entries=20)) == plain_reading(rows, entries=20)
    # other lengths than the most frequent are dropped
    assert got(vc.compress(df.union(spark.createDataFrame([(1, [1.0] * 4, 1, "", 1, "", 1)], SCHEMA)), entries=20)) == plain_reading(rows, entries=20)
    for none in (df.limit(0), df.where("embedding is null")):
        assert vc.compress(none).collect() == []


def test_lengths_and_sizes(spark):
    rows = [(i, [i / 7, -i / 5, i * 1000.0, 0.1, -1e30][:5], None, "", 1, "", 1) for i in range(30)]
    out = vc.compress(spark.createDataFrame(rows, SCHEMA), entries=4).collect()
    assert len(out) == 30 and all(len(r.code) == 8 and 0 <= r.error <= r.label_error for r in out)


def test_a_round_scans_few_parts_and_gives_the_same():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (16, 8))
    x = np.floor(centres[rng.integers(0, 16, 3000)] + rng.normal(0, 40, (3000, 8))).astype(np.int64)
    books = x[:16].reshape(1, 16, 8).copy()
    heaps, codes, drift, scans = [vc.Heaps(16, np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32))], np.zeros((3000, 1), np.uint8), np.zeros((1, 16)), []
    for r in range(8):
        scans.append(vc.assign_block(x, codes, heaps, books, drift, r == 0))
        assert (codes[:, 0] == vc.nearest(x, books[0])[0]).all()
        keys, order, sizes = heaps[0].arrays()
        heaps = [vc.Heaps(16, np.frombuffer(keys), np.frombuffer(order, "<i4"), np.frombuffer(sizes, "<i4"))]
        moved = np.array([x[codes[:, 0] == e].sum(0) // max(1, (codes[:, 0] == e).sum()) if (codes[:, 0] == e).any() else books[0, e] for e in range(16)])
        moves = np.sqrt(((moved - books[0]) ** 2).sum(1))
        drift[0] += moves + np.array([np.delete(moves, e).max() for e in range(16)])
        books = moved[None]
    assert scans[0] == 3000 and scans[-1] < 600


def test_large_numbers_are_exact():
    x = np.array([[1 << 25, -(1 << 25), 3], [1, 2, 3]])
    book = np.array([[1 << 25, -(1 << 25), 2], [1 << 25, -(1 << 25), 4], [-(1 << 25), 1 << 25, 0]])
    best, slack = vc.nearest(x, book)
    assert best.tolist() == [0, 2] and slack[0] == 0

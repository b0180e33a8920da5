import hashlib
import re
from collections import Counter, defaultdict

import duckdb

from tallyweave.llm import mixing
from tallyweave.llm.queries import ORACLE_SQL

from .rows import documents, empty


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def h(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:12], 16)


def water(sizes):
    """Targets by resharing what is over the caps until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_equals_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    target = water(sizes)
    below = {}
    for s in sizes:
        by = defaultdict(int)
        for r in rows:
            if r.source == s and size(r.text):
                by[h(r.doc_id)] += size(r.text)
        left, upto = target[s] - min(3, int(target[s] // sizes[s])) * sizes[s], 0
        below[s] = 1 << 48
        for x in sorted(by):
            upto += by[x]
            if upto - by[x] / 2 > left:
                below[s] = x
                break
    want = sorted(((r.doc_id, size(r.text), sizes[r.source], round(target[r.source], 6), size(r.text) * (min(3, int(target[r.source] // sizes[r.source])) + (h(r.doc_id) < below[r.source]))) for r in rows), key=str)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got), key=str) == want
    assert all(r.taken <= 3 * r.size for r in got)


def test_near_targets_and_rows_repeat(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), ["a", "b", "c"][i * i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 7
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.times for r in got if r.times})


def test_caps_and_one_source(spark):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "", "t")]
    got = {r.doc_id: (r.size, r.taken) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: (3, 3), 2: (0, 0), 3: (0, 0)}


def test_empty_table(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    docs = documents(spark, repeat=False).select("doc_id", "text", "source")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.sql(ORACLE_SQL["op6_mixing"]).fetchall())
    got = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want

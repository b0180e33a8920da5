import random

import xxhash

from tallyweave.llm import common, simhash
from tallyweave.llm.components import components

from .rows import documents, empty


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids):
    """Smallest reachable key; ids: [(key, fingerprint)]."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    prints = sorted({f for _, f in ids})
    for i, a in enumerate(prints):
        for b in prints[i:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for key, f in ids:
        least[find(f)] = min(least.get(find(f), key), key)
    return {f: least[find(f)] for _, f in ids}


def test_documents(spark):
    docs = documents(spark, repeat=False)
    got = simhash.near_duplicates(docs).collect()
    want = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == want
    groups = brute_groups(list(want.items()))
    assert all(r.component_id == groups[want[r.doc_id]] for r in got)
    kept = simhash.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == {groups[f] for f in want.values()}
    assert kept.columns == docs.columns


def test_repeated_ids_and_nulls(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs)
    assert got.count() == docs.count()
    assert got.where("doc_id = 21").select("component_id").distinct().count() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(docs).where("doc_id is null").count() == 2


def linked(spark, prints, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(prints)], "fp long, rep long")
    roots = {r.node: r.root for r in components(simhash.links(rows)).collect()}
    want = brute_groups(list(enumerate(prints)))
    assert {i: roots.get(i, i) for i in range(len(prints))} == {i: want[f] for i, f in enumerate(prints)}


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for base in list(prints)[:6]:  # clouds of near fingerprints, which share keys
        for _ in range(60):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    for parts, crowd in (("4", 128), ("4", 3), ("40", 8)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        linked(spark, prints, monkeypatch, crowd)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_keys_join_like_others(spark, monkeypatch):
    left = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) as k", "id as v")
    right = left.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as w")
    want = {(r.k, r.v, r.w) for r in left.join(right, "k").collect()}
    for rows in (1, 1000, 10**9):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        got = common.join_counted(left, right, "k", 5000).collect()
        assert len(got) == 5000 and {(r.k, r.v, r.w) for r in got} == want


def test_long_chains_and_stars_become_one_component(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (100, 99)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {500 + i: 500 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

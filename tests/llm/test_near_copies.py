import random

from tallyweave.llm import near_copies as n

from .rows import documents, empty


def brute(rows):
    """{doc_id: smallest doc_id of its component}; rows: [(doc_id, text)]."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = {d: d for d, _ in rows}
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((root[a], root[rows[j][0]]))
                root = {d: x if r == y else r for d, r in root.items()}
    return root


def edited(n_texts=60, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n_texts):
        own = rng.choices(words, k=rng.randint(120, 260))
        for e in (0, 1, 2, 3, 4, 6, 9):
            copy = list(own)
            for at in rng.sample(range(len(own)), e):
                copy[at] = "edit%d" % rng.randrange(10**6)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_edited_copies_go(spark):
    rows = edited()
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in n.near_copies(docs).collect()} == want
    assert len(set(want.values())) < 210
    assert {r.doc_id for r in n.keep_one(docs).collect()} == set(want.values())


def test_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rows = edited(12, 8)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {r.doc_id for r in near(spark, docs, "").collect()} == set(brute(rows).values())


def test_large_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(n, "PART_TEXTS", 3)
    rows = edited(8, 9)
    assert {r.doc_id: r.component_id for r in n.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_odd_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute([x for x in rows if x[0] is not None])
    assert sorted((r.doc_id for r in n.keep_one(docs).collect()), key=str) == sorted((d for d, _ in rows if d is None or want[d] == d), key=str)
    assert n.keep_one(empty(spark)).count() == 0


def test_shared_texts_and_the_rest_of_a_group_are_enough(spark, monkeypatch):
    monkeypatch.setattr(n, "PART_TEXTS", 4)
    monkeypatch.setattr(n, "SHARED", 2)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    own = rng.choices(words, k=200)
    rows = []
    for i in range(60):  # a chain of texts, each a step from the one before: few are like the shared ones
        own = list(own)
        for at in rng.sample(range(200), 3):
            own[at] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: r.component_id for r in n.near_copies(docs).collect()} == brute(rows)


def test_keys_cut_by_borders_connect_all(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    keyed = spark.range(400).selectExpr("id as fp", "if(id < 300, 7, id div 5) as key")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    from tallyweave.llm.components import components

    got = {r.node: r.root for r in components(n.met(keyed)).collect()}
    assert got == {i: 0 if i < 300 else i // 5 * 5 for i in range(400)}


def test_candidates_come_by_simhash(spark, monkeypatch):
    """Without keys from minima, copies whose fingerprints are near are found all the same, and only those that the sets confirm."""
    monkeypatch.setattr(n, "keys", lambda of: of[:0])
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        own = rng.choices(words, k=4000)
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join([*own[:-1], "edit"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: (r.fp, r.sim) for r in n.classes(docs).collect()}
    bits = lambda a, b: ((prints[a][1] ^ prints[b][1]) & (1 << 64) - 1).bit_count()
    near = {(a, b) for a in range(24) for b in range(a) if bits(a, b) <= 2}
    assert 8 <= len(near) and all(a // 2 == b // 2 for a, b in near)
    linked = {frozenset((r.a, r.b)) for r in n.simhash_links(n.classes(docs)).collect()}
    assert linked == {frozenset((prints[a][0], prints[b][0])) for a, b in near if bits(a, b)}
    assert {r.doc_id: r.component_id for r in n.near_copies(docs).collect()} == {d: d - 1 if (d, d - 1) in near else d for d, _ in rows}
    assert n.simhash_links(n.classes(empty(spark))).count() == 0

import random

import numpy as np

from tallyweave.llm import labelled, ngrams, quality_classifier, quality_rules

from .rows import documents, empty, texts


def brute(body):
    words = body.split()
    covered = set()
    windows = list(zip(words, words[1:], words[2:]))
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    seen, dups = [], 0
    for line in body.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            dups += line in seen
            seen.append(line)
    text = body.decode()
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def labelled_docs(spark, n=400):
    rng = random.Random(1)
    words = ["".join(rng.choice(["th", "nd", "er", "ou", "la"]) for _ in range(3)) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        own = rng.choices(words, k=80)
        good = i % 4 != 0
        docs.append((i, " ".join(own if good else [w + rng.choice(["***", "%%%", "!!"]) for w in own])))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts_equal_brute_force():
    for t in texts():
        if t is None or len(t) < 20_000:
            b = (t or "").encode()
            assert quality_rules.base_counts(b) == brute(b), t


def test_rules_on_awkward_rows(spark):
    docs, labels = labelled_docs(spark)
    model = quality_rules.train(docs, labels)
    rows = documents(spark)
    got = quality_rules.judge(rows, model).collect()
    assert len(got) == rows.count()
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= quality_rules.MIN_PROBABILITY)
    kept = quality_rules.judge(rows, model, carry=True)
    assert kept.columns[:-1] == rows.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judge(empty(spark), model).count() == 0


def test_model_tells_good_from_bad_and_is_calibrated(spark):
    docs, labels = labelled_docs(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()
    assert all(r.kept == bool(truth[r.doc_id]) for r in got)
    assert abs(np.mean([r.probability for r in got]) - 0.75) < 0.1


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled_docs(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert 40 < len(held) < 120
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_collapsed_tables_equal_the_mean_of_vectors(spark):
    docs, labels = labelled_docs(spark, 80)
    model = quality_classifier.fit(labelled.sample(docs, labels))
    words, runs, bias = model.tables()
    body = b"thnder outh *** la"
    ids, values = ngrams.sparse(body)
    mean = values @ model.vectors[ids]
    logits = model.classes @ mean + model.biases
    assert abs(ngrams.sums([body], words, runs)[0] + bias - (logits[1] - logits[0])) < 1e-3


def test_no_labels_and_odd_labels(spark):
    docs, _ = labelled_docs(spark, 40)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1), (3, 1), (3, 1), (999, 0)], "doc_id long, quality int")
    for labels in (none, odd):
        assert quality_rules.train(docs, labels) is None
        assert {r.score for r in quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()} == {0.5}
    assert {r.probability for r in quality_rules.judge(docs, None).collect()} == {0.5}


def test_rows_of_the_score_only_depend_on_the_text():
    table = np.random.default_rng(0).normal(size=(2, ngrams.BUCKETS)).astype(np.float32)
    bodies = [(t or "").encode() for t in texts()]
    together = ngrams.sums(bodies, *table)
    alone = np.array([ngrams.sums([b], *table)[0] for b in bodies])
    assert np.allclose(together, alone, atol=1e-4)
    for b in bodies[:40]:
        ids, values = ngrams.sparse(b)
        assert abs(values @ table.ravel()[ids] - ngrams.sums([b], *table)[0]) < 1e-3


def test_long_texts_lose_no_feature():
    words = [f"w{i:x}" for i in range(60_000)]
    many, one = " ".join(words).encode(), b"x" * 300_000
    odd = ("é" * 200_000 + " " + "🙂b" * 100_000 + "\n \t" * 90_000 + "end of it").encode()
    for body in (many, one, odd):
        parts = [(u, p) for _, uses, found in ngrams.blocks([body]) for u, p in zip(uses, found)]
        assert b"".join(p for u, p in parts if u == ngrams.WHOLE) == body
        got = [ngrams.hashed(uses, found) for _, uses, found in ngrams.blocks([body])]
        whole = ngrams.hashed([ngrams.WHOLE], [body])
        for k in (0, 2):
            assert (np.sort(np.concatenate([g[k] for g in got])) == np.sort(whole[k])).all()
    assert len(ngrams.hashed([0], [many])[0]) == 119_999 and len(ngrams.hashed([0], [one])[0]) == 1


def features(text):
    """Brute force, one text at a time: shares of words, pairs and runs of four characters by the same hashes."""
    mask, out = (1 << 64) - 1, [{}, {}]
    sizes = [0, 0]

    def put(k, h):
        i = (h * int(ngrams._ODD) & mask) >> (64 - ngrams.BUCKETS_LOG2)
        out[k][i] = out[k].get(i, 0) + 1
        sizes[k] += 1

    words = []
    for w in text.encode().split():
        h = 1
        for i, c in enumerate(w.decode()):
            h = (h + ord(c) * pow(int(ngrams._P), i, 1 << 64)) & mask
        words.append(h)
        put(0, h)
    for a, b in zip(words, words[1:]):
        put(0, int(ngrams._TWICE) if a == b else (a * 0xD6E8FEB86659FD93 + b) & mask)
    for i in range(len(text) - 3):
        h = 0
        for c in text[i : i + 4]:
            h = (h * int(ngrams._P) + ord(c)) & mask
        put(1, h)
    return [{i: n * ngrams.SCALE / sizes[k] for i, n in out[k].items()} for k in (0, 1)]


def test_scores_equal_a_plain_reading_of_the_models(spark):
    docs, labels = labelled_docs(spark, 120)
    odd = ["", "a", "Übermäßig ß É 日本 🙂 日本 🙂", "twice twice twice", "so  it\ngoes\tx"]
    rows = docs.collect()[:20]
    table = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + [(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    texts_of = {r.doc_id: r.text for r in table.collect()}
    model = quality_classifier.train(docs, labels)
    for r in quality_classifier.score(table, model).collect():
        words, runs = features(texts_of[r.doc_id])
        mean = sum((v * model.vectors[i] for i, v in words.items()), np.zeros(quality_classifier.DIMENSIONS)) + sum((v * model.vectors[ngrams.BUCKETS + i] for i, v in runs.items()), np.zeros(quality_classifier.DIMENSIONS))
        z = model.classes @ mean + model.biases
        assert abs(r.score - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-3
    rules = quality_rules.train(docs, labels)
    for r in quality_rules.judge(table, rules).collect():
        words, runs = features(texts_of[r.doc_id])
        raw = sum(v * rules.word_table[i] for i, v in words.items()) + sum(v * rules.run_table[i] for i, v in runs.items()) + rules.bias
        p = 1 / (1 + np.exp(-(rules.slope * raw + rules.offset)))
        assert abs(r.probability - p) < 1e-3 and r.kept == (not r.base_failed and r.probability >= quality_rules.MIN_PROBABILITY)


def test_training_is_plain_gradient_descent(spark):
    """The classifier's first step against the gradient worked out by differences."""
    docs, labels = labelled_docs(spark, 12)
    data = labelled.sample(docs, labels)
    model = quality_classifier.fit(data, epochs=3)

    def loss(m):
        total = 0.0
        for i in range(len(data)):
            ids, values = data.row(i)
            z = m.classes.astype(float) @ (values @ m.vectors[ids]) + m.biases
            total -= z[int(data.label[i])] - np.log(np.exp(z).sum())
        return total / len(data)

    start = quality_classifier.Embeddings(np.zeros_like(model.vectors), np.random.default_rng(7).normal(0, 0.5, model.classes.shape), np.zeros(2))
    assert loss(model) < loss(start)


def test_features_are_bounded_together(spark, monkeypatch):
    docs, labels = labelled_docs(spark, 60)
    whole = labelled.sample(docs, labels)
    monkeypatch.setattr(labelled, "MAX_FEATURES", len(whole.ids) // 3)
    some = labelled.sample(docs, labels)
    assert 0 < len(some.ids) <= len(whole.ids) // 3 and set(some.doc_id) < set(whole.doc_id)

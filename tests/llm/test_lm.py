import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from tallyweave.llm import bpe, lm
from tallyweave.llm.queries import RANKS

from .rows import documents, empty

V = lm.segmenter(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def words(t):
    return (t or "").encode().lower().split() + [None]


@pytest.fixture(scope="module")
def scored(spark):
    docs = documents(spark)
    return docs.collect(), lm.score(docs, RANKS, public_tokenizers.PATTERN).collect()


def test_base_equals_brute_force(scored):
    rows, got = scored
    c = Counter()
    for r in rows:
        if not held(r.doc_id):
            c.update(words(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), held(r.doc_id), len(words(r.text)), sum(c[w] > 0 for w in words(r.text)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r.text)), 4)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_scores_are_log_probabilities(scored):
    _, got = scored
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_table_and_no_training_text(spark):
    assert lm.score(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    only = next(i for i in range(100) if held(i))
    r = lm.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and math.isclose(r.base_score, 0) and r.score < 0


def block(texts):
    return lm._pack(list(range(len(texts))), [False] * len(texts), pa.array([t.encode() for t in texts], pa.binary()), V)


def model(row, classes=None):
    counts = np.zeros(len(V.tokens) + 1)
    counts[row[9]] = row[10]
    order = lm.frequent(counts)
    s = lm.shape(counts, V.tokens, order, np.arange(lm.TOP) % lm.CLASSES if classes is None else classes)
    return s, lm.start(s)


def test_words_of_texts():
    """Against Python's own lowering and splitting of bytes, also of bytes that are no UTF-8."""
    rng = random.Random(1)
    for _ in range(300):
        bodies = [bytes(rng.choice([32, 9, 10, 11, 12, 13, 28, 31, 0x85, 0xA0, 65, 97, 0xC3, 0x89, 66, 0]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        n, which, distinct = lm._words(pa.array([b"before", *bodies], pa.binary()).slice(1))
        want = [x.lower().split() for x in bodies]
        assert n.tolist() == [len(x) for x in want] and [distinct[i] for i in which] == [w for x in want for w in x]


def test_words_keep_their_own_subwords():
    for words in (["a", "the", "ünder", "x" * 300], ["\u3000", "\u3000", "b"], ["\x85", "\x85q"], ["\xa0"], []):
        n, sub = V.segment([w.encode() for w in words])
        at = np.concatenate(([0], np.cumsum(n))).astype(int)
        assert [b"".join(V.tokens[i] for i in sub[a:b]).decode() for a, b in zip(at, at[1:])] == [" " + w for w in words]


def test_every_token_is_scored_once_with_context():
    row = block(["a b c d e f g " * 9, "", "x", "word " * 14])
    stream = lm.Stream(row[3], row[2], row[7], row[8])
    seen = np.zeros(len(stream.subs), int)
    for w in range(len(stream.doc)):
        at = stream.start[w] + np.arange(lm.CONTEXT)
        new = at[(at < stream.end[stream.doc[w]]) & (np.arange(lm.CONTEXT) >= stream.fresh[w])]
        seen[new] += 1
        assert all(p - stream.start[w] >= lm.OVERLAP or stream.start[w] == stream.begin[stream.doc[w]] for p in new)
    assert (seen == 1).all()
    s, _ = model(row)
    rows, targets, scored = stream.windows(np.arange(len(stream.doc)), s)
    assert scored.sum() == len(stream.subs) and Counter(targets[scored]) == Counter(stream.subs)


def test_probabilities_of_all_subwords_sum_to_one():
    row = block(["some text to count " * 5])
    s, m = model(row)
    m = {n: a + np.random.default_rng(1).normal(0, 0.1, a.shape).astype(np.float32) for n, a in m.items()}
    h = np.random.default_rng(2).normal(size=(1, lm.DIMENSIONS)).astype(np.float32)
    every = np.arange(len(s.row))
    assert abs(np.exp(lm.logs(m, s, np.repeat(h, len(every), 0), every).astype(np.float64)).sum() - 1) < 1e-3


def test_attention_is_causal():
    row = block(["a b c d e f g h i j k l m n o p q r s t"])
    s, m = model(row)
    stream = lm.Stream(row[3], row[2], row[7], row[8])
    rows = stream.windows(np.array([0]), s)[0]
    other = rows.copy()
    other[0, 9:] = 5
    assert np.allclose(lm.attend(m, rows)[0][0, :9], lm.attend(m, other)[0][0, :9], atol=1e-5)


def test_gradient_equals_differences():
    row = block(["the cat and the dog and the bird sang to the moon " * 7])  # three windows
    s, m = model(row)
    rng = np.random.default_rng(3)
    m = {n: (a + rng.normal(0, 0.2, a.shape)).astype(np.float64) for n, a in m.items()}
    stream = lm.Stream(row[3], row[2], row[7], row[8])
    rows, targets, scored = stream.windows(np.arange(3), s)
    weigh = scored.astype(np.float64)

    def loss():
        return -(lm.logs(m, s, lm.attend(m, rows)[0].reshape(-1, lm.DIMENSIONS), targets.ravel()) * weigh.ravel()).sum() / weigh.sum()

    g = lm.gradient(m, s, rows, targets, weigh)
    for name in m:
        big = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was, step = m[name][big], 1e-5
        m[name][big] = was + step
        up = loss()
        m[name][big] = was - step
        down = loss()
        m[name][big] = was
        assert abs((up - down) / (2 * step) - g[name][big]) < 1e-3 * max(1, abs(g[name][big])), name


def test_learning_beats_the_start():
    row = block(["one two three four five six seven eight nine ten " * 40])
    s, m = model(row)
    stream = lm.Stream(row[3], row[2], row[7], row[8])
    rows, targets, scored = stream.windows(np.arange(len(stream.doc)), s)
    many = [np.tile(x, (80 * lm.BATCH // len(rows), 1)) for x in (rows, targets, scored.astype(np.float32))]  # enough steps to learn from
    learned = lm.learn(m, s, *many, 0.02, 1)
    assert stream.scores(learned, s).sum() > 0.7 * stream.scores(m, s).sum()


def test_classes_are_of_one_size():
    follows = np.random.default_rng(0).poisson(2, (lm.COMPANY, lm.TOP)).astype(float)
    assert set(np.bincount(lm.alike(follows), minlength=lm.CLASSES)) == {lm.MEMBERS}


def test_rounds_learn_from_every_training_window():
    row = block(["one two three four five six seven eight nine ten " * 40, "a held out text " * 30, "another text to learn from " * 50])
    stream = lm.Stream(row[3], row[2], row[7], row[8])
    s, _ = model(row)
    taken = [stream.lessons([False, True, False], i, lm.ROUNDS, s) for i in range(lm.ROUNDS)]
    learned = np.concatenate([targets[scored] for _, targets, scored in taken])
    want = np.concatenate([stream.subs[a:b] for i, (a, b) in enumerate(zip(stream.begin, stream.end)) if i != 1])
    assert Counter(learned.tolist()) == Counter(want.tolist())


def test_scores_equal_a_plain_reading_of_the_model():
    """Brute force: one token at a time, with loops over positions, classes and members."""
    row = block(["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, "", "the cat and the dog"])
    s, m = model(row)
    rng = np.random.default_rng(4)
    m = {n: (a + rng.normal(0, 0.3, a.shape)).astype(np.float32) for n, a in m.items()}
    stream = lm.Stream(row[3], row[2], row[7], row[8])
    want = []
    for begin, end in zip(stream.begin, stream.end):
        total, at, first = 0.0, begin, True
        while True:
            window = [stream.subs[i - 1] if i > 0 else len(s.row) - 1 for i in range(at, min(at + lm.CONTEXT, end))]
            x = np.array([m["e"][s.row[w]] + m["p"][i] for i, w in enumerate(window)], np.float64)
            for i in range(0 if first else lm.OVERLAP, len(window)):
                weights = np.array([np.exp((x[i] @ m["q"]) @ (x[j] @ m["k"]) / math.sqrt(lm.DIMENSIONS)) for j in range(i + 1)])
                mixed = sum(w * (x[j] @ m["v"]) for j, w in enumerate(weights / weights.sum()))
                h, target = x[i] + mixed @ m["o"], stream.subs[at + i]
                classes = np.exp(h @ m["w"] + m["b"])
                total += math.log(classes[s.kind[target]] / classes.sum())
                if s.member[target] >= 0:
                    members = np.exp(h @ m["u"][s.kind[target]] + m["c"][s.kind[target]])
                    total += math.log(members[s.member[target]] / members.sum())
                else:
                    total += s.share[target]
            if at + lm.CONTEXT >= end:
                break
            at, first = at + lm.CONTEXT - lm.OVERLAP, False
        want.append(total / math.log(10))
    assert np.allclose(stream.scores(m, s), want, rtol=1e-3)


def test_model_beats_counts_of_subwords(spark):
    """Held-out texts of a language with order score better than by the start's shares."""
    rng = np.random.default_rng(6)
    after = {i: rng.choice(60, 3, replace=False) for i in range(60)}
    docs = []
    for i in range(500):
        w, steps = [int(rng.integers(60))], rng.integers(0, 3, 700).tolist()
        for k in steps:
            w.append(int(after[w[-1]][k]))
        docs.append((i, " ".join(f"{chr(97 + x // 8)}{chr(97 + x % 8)}x" for x in w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = lm.score(df, RANKS, public_tokenizers.PATTERN).where("held_out").toPandas()
    assert got.score.sum() / got.n_tokens.sum() > got.base_score.sum() / got.n_tokens.sum() + 0.2


def test_counts_come_by_ranges_of_words(spark, monkeypatch):
    """Against counting; a row holds many words, and as many ranges are cut as words ask for."""
    monkeypatch.setattr(lm, "PART_WORDS", 40)
    docs = documents(spark).repartition(3)
    made = lm.blocks(docs, RANKS, public_tokenizers.PATTERN)
    want = Counter()
    for r in docs.collect():
        if not held(r.doc_id):
            want.update(words(r.text)[:-1])
    counts = lm.word_counts(made)
    rows = counts.collect()
    assert 1 < len({r.part for r in rows}) and len(rows) == len({(r.block, r.part) for r in rows}) < made.agg({"n_words": "sum"}).first()[0]
    assert (sum(r.n_words for r in rows), sum(r.n_train for r in rows)) == (len(want), want.total())
    for b in made.collect():
        got = np.frombuffer(b"".join(bytes(r.c) for r in sorted(rows, key=lambda r: r.part) if r.block == b.block), np.int64)
        ends = np.cumsum(np.frombuffer(b.word_sizes, np.int32))
        assert [want[bytes(b.words[e - n : e])] for n, e in zip(np.frombuffer(b.word_sizes, np.int32), ends)] == got.tolist()


def test_a_file_holds_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        made = lm.blocks(spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string").coalesce(1), RANKS, public_tokenizers.PATTERN)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [r["count"] for r in made.selectExpr("input_file_name() as f").groupBy("f").count().collect()]
    assert sum(files) == 30 and max(files) <= 4


def test_a_merge_holds_few_megabytes(spark):
    """However many tasks there are: results of 1 MB are merged 8 at a time, not 64."""

    def add(key, rows):
        most = max([len(rows), *(int.from_bytes(b, "little") for b in rows["most"])])
        return pd.DataFrame({"part": [key[0]], "n": [int(rows["n"].sum())], "most": [most.to_bytes(4, "little")]})

    local = spark.range(300).selectExpr("id as part", "1L as n", "unhex('00000000') as most")
    got = lm._tree(local, add, "part long, n long, most binary", 300, 1 << 20)
    assert got["n"] == 300 and int.from_bytes(got["most"], "little") <= 8


def test_only_positions_that_are_scored_ask():
    """Windows whose first positions were scored before ask from OVERLAP on; what comes out is the same."""
    row = block(["the cat and the dog and the bird sang to the moon " * 7])
    s, m = model(row)
    m = {n: a + np.random.default_rng(6).normal(0, 0.2, a.shape).astype(np.float32) for n, a in m.items()}
    stream = lm.Stream(row[3], row[2], row[7], row[8])
    rows = stream.windows(np.arange(len(stream.doc)), s)[0]
    assert np.allclose(lm.attend(m, rows, lm.OVERLAP)[0], lm.attend(m, rows)[0][:, lm.OVERLAP :], atol=1e-5)


@pytest.mark.parametrize("far", [0.0, 59.0, 70.0, -70.0, 500.0, -500.0])
def test_bounds_hold_where_they_matter(far):
    """Logits beyond 60 either way count as that, masked ones as nothing, though most rows aren't read for it."""
    z = np.random.default_rng(7).normal(size=(6, 8)).astype(np.float32)
    z[2] += far
    z[4, 3] += far
    mask = np.where(np.arange(8) > np.arange(6)[:, None], np.float32(-1e9), np.float32(0))
    for hide in (None, mask):
        e, total = lm._powers(z.copy() if hide is None else z + hide, hide)
        want = np.exp(np.clip(z.astype(np.float64), -60, 60)) * (1 if hide is None else hide == 0)
        assert np.isfinite(e).all() and (total > 0).all()
        assert np.allclose(e / total[:, None], want / want.sum(1, keepdims=True), atol=1e-5)


def test_words_are_hashed_and_spaced_as_arrays():
    words = [b"a", b"b", b"ab", b"ba", b"x" * 300, b"x" * 301, "ünder".encode(), *(f"w{i}".encode() for i in range(5000))]
    array = pa.array([b"before", *words], pa.binary()).slice(1)
    got = lm._hashes(array).tolist()
    assert got == [int(lm._hashes(pa.array([w], pa.binary()))[0]) for w in words[:7]] + got[7:]
    assert len(set(got)) > len(words) - 3 and np.bincount(np.array(got) >> 29, minlength=8).min() > 500
    assert lm._spaced(array) == b" " + b" ".join(words) and len(lm._hashes(array[:0])) == 0


def test_rows_are_added_up():
    rng = np.random.default_rng(8)
    rows, x = rng.integers(0, 50, 400).astype(np.int32), rng.normal(size=(400, 16)).astype(np.float32)
    want = np.zeros((60, 16), np.float32)
    np.add.at(want, rows, x)
    got = lm._summed(np.zeros((60, 16), np.float32), rows, x)
    assert got.dtype == np.float32 and np.allclose(got, want, atol=1e-4)

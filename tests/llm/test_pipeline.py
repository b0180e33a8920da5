import importlib.util

import pytest

from .rows import documents, empty
from .test_line_dedup import brute as brute_lines
from .test_near_copies import brute as brute_near
from .test_quality import labelled_docs

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline's file isn't there")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels = labelled_docs(spark, 240)
    line = "\na line that is common to many of these documents, word for word"
    docs = docs.selectExpr("doc_id", f"concat(text, if(doc_id % 5 = 1, '{line}', ''), if(doc_id % 40 = 2, '', '')) as text", "'en' as lang", "concat('s', doc_id % 3) as source", "0L as n_chars")
    copies = docs.where("doc_id < 40").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars")
    docs.union(copies).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_do_what_they_say(spark, folder):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    quality, lines, near, mixture, tokens = [f for _, f in corpus_pipeline.STAGES]
    kept = quality(spark, docs, folder)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if r.doc_id % 4}
    cut = lines(spark, kept, folder)
    want = {d: n for d, _, n, _ in brute_lines(kept.collect())}
    assert {r.doc_id for r in cut.collect()} == set(want) and sum(want.values()) > 20
    assert sum("word for word" in r.text for r in cut.collect()) == 1
    one = near(spark, cut, folder)
    groups = brute_near([(r.doc_id, r.text) for r in cut.collect()])
    assert {r.doc_id for r in one.collect()} == set(groups.values()) and len(groups) > len(set(groups.values()))
    mixed = mixture(spark, one, folder)
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(one.collect())
    assert tokens(spark, mixed, folder).count() == mixed.count()


def test_run_equals_stages_in_a_row(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, folder)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, very long and empty texts, clashing names, and empty tables."""
    import corpus_pipeline

    docs = documents(spark)
    _, labels = labelled_docs(spark, 40)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table, some in ((docs, True), (empty(spark), False)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, str(tmp_path))
            path = f"{tmp_path}/{name}-{some}"
            after.write.parquet(path)
            after = spark.read.parquet(path)
            assert after.columns == docs.columns
            now = after
        tokens = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (tokens.count() == now.count() > 0) == some


def test_every_stage_bounds_what_executors_hold_at_once(spark, folder):
    """4096 long texts decoded into one array, and batches of any size on their way to Python, go beyond an executor's memory."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    arrow, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {key: spark.conf.get(key) for key in (arrow, rows)}
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(arrow, str(8 << 20))
            spark.conf.set(rows, "4096")
            stage(spark, docs, folder)
            assert int(spark.conf.get(arrow)) <= 2 << 20 and int(spark.conf.get(rows)) <= 256
            spark.conf.set(arrow, "1000")  # a lower bound stays
            spark.conf.set(rows, "10")
            stage(spark, docs, folder)
            assert (spark.conf.get(arrow), spark.conf.get(rows)) == ("1000", "10")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

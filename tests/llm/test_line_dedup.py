import hashlib
from collections import defaultdict

from tallyweave.llm import line_dedup

from .rows import documents, empty

W = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    at = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            at[lower(line.strip(W))].add(-1 if r.doc_id is None else r.doc_id)
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        own = -1 if r.doc_id is None else r.doc_id
        kept = [x for x in lines if not (len(k := lower(x.strip(W))) >= 40 and len(at[k]) >= 5 and own != max(at[k]))]
        out.append((r.doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force_over_any_partitioning(spark):
    docs = documents(spark)
    want = brute(docs.collect())
    assert sum(x[2] for x in want) > 5
    for parts in ("1", "4", "60"):  # many parts: the common line is cut by borders
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = line_dedup.dedup_report(docs).drop("keep").collect()
        assert sorted(map(tuple, got), key=str) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_texts_keep_rows_and_columns(spark):
    docs = documents(spark)
    out = line_dedup.dedup_texts(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    hashes = {(d, h) for d, _, _, h in brute(docs.collect())}
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()} == hashes


def test_empty_table(spark):
    assert line_dedup.dedup_report(empty(spark)).count() == 0
    assert line_dedup.dedup_texts(empty(spark)).count() == 0

from __future__ import annotations

import io
import zipfile

import duckdb
from pyspark.sql import functions as F

from tallyweave.operators import records, reports
from tallyweave.plans.oracle import ORACLE_SQL
from tallyweave.plans.queries import QUERIES
from tallyweave.sources import files


def test_event_log_skips_broken_lines_and_appends(spark, tmp_path):
    p = str(tmp_path / "log")
    rows = spark.createDataFrame([("2024-01-01", "propuesta", 1), ("2024-02-01", "decision", 2)], "ts string, evento string, provider_id int")
    files.append_events(rows, p)
    (tmp_path / "log" / "more.json").write_text('{"ts": "2024-03-01", "evento": "decision", "provider_id": 2}\n{broken\n\n[1]\n')
    (tmp_path / "log" / "odd.json").write_text('{"ts": "2024-04-01", "evento": "decision", "provider_id": "many"}\n')
    log = files.read_events(spark, p)
    assert log.count() == log.select("ts").count() == len(log.collect()) == 4
    assert [r.provider_id for r in log.where("ts = '2024-04-01'").collect()] == [None]
    assert files.read_events(spark, p, since="2024-02-01", provider=2).count() == 2


def test_dump(spark):
    lines = ["INSERT INTO t VALUES", "(1,'a, b','it\\'s',NULL),", " (2,'','x',5);", "(3,'short'),", ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = files.dump_rows(df, "id int, a string, b string, c int", least=4).orderBy("id").collect()
    assert [(r.id, r.a, r.b, r.c) for r in got] == [(1, "a, b", "it's", None), (2, got[1].a, "x", 5)] and not got[1].a


def test_unzip(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ("a/x.pdf", "b/x.PDF", "c/x.pdf", "../y.txt"):
            z.writestr(name, name)
    df = spark.createDataFrame([("one", bytearray(out.getvalue())), ("bad", bytearray(b"no zip")), ("none", None)], "path string, content binary")
    assert sorted((r.path, r.name, bytes(r.content).decode()) for r in files.unzip(df).collect()) == [("one", "x.PDF", "b/x.PDF"), ("one", "x.pdf", "a/x.pdf"), ("one", "x_2.pdf", "c/x.pdf")]


def test_encrypted_members_give_no_rows(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.pdf", b"plain")
        z.writestr("b.pdf", b"secret")
    raw = bytearray(out.getvalue())
    at = raw.find(b"PK\x01\x02", raw.find(b"PK\x01\x02") + 1)
    raw[at + 8] |= 1  # the second member says that it's encrypted
    got = files.unzip(spark.createDataFrame([("one", raw)], "path string, content binary")).collect()
    assert [r.name for r in got] == ["a.pdf"]


def test_listing_store_and_reports(spark, tmp_path):
    for name in ("b.PDF", "sub/A.pdf", "c.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"12345")
    assert [(r.name, r.bytes) for r in files.list_files(spark, str(tmp_path / "in")).collect()] == [("A.pdf", 5), ("b.PDF", 5)]
    root = str(tmp_path / "store")
    for v in (1, 2):
        files.save_store(spark.range(v), root, v)
    (tmp_path / "store" / "version=3").mkdir()  # a write that never ended
    assert files.load_store(spark, root).count() == 2
    for kind in ("csv", "json"):
        files.write_report(spark.range(3), str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 3


def test_only_known_fields_are_patched(spark):
    import pytest

    with pytest.raises(ValueError):
        records.patch(spark.range(1), spark.range(1).selectExpr("id", "1 as provider_id"), ["provider_id"], ["id"])


def test_skipped_names(spark):
    df = spark.createDataFrame([("DUA 12.pdf",), ("12 DUA.pdf",), ("--dua.pdf",), ("invoice.pdf",), ("",)], "n string")
    assert [r[0] for r in df.select(files.skipped(F.col("n"), ["DUA", "AWB"])).collect()] == [True, False, True, False, False]


def test_words_to_rows(spark):
    words = spark.createDataFrame([(1, 10.2, 50.0, "b"), (1, 10.9, 5.0, "a"), (1, 30.0, 1.0, "c")], "page int, top double, x0 double, text string")
    assert sorted(r.text for r in files.word_rows(words, 2.0).collect()) == ["a b", "c"]


def test_kept_edits(spark):
    old = spark.createDataFrame([(1, " Rose A", "L1", False), (1, "Rose B", None, True), (1, "Rose C", None, True)], "doc_id int, raw string, label string, deleted boolean")
    new = spark.createDataFrame([(1, "rose a", 1.0), (1, "rose a", 2.0), (1, "rose b", 3.0), (1, "rose d", 4.0)], "doc_id int, raw string, amount double")
    got = {(r.k, r.amount): (r.label, r.deleted) for r in records.keep_edits(old, new).collect()}
    assert got == {("rose a", 1.0): ("L1", False), ("rose a", 2.0): ("L1", False), ("rose b", 3.0): (None, True), ("rose d", 4.0): (None, False), ("rose c", None): (None, True)}


def test_orphans_count_each_use_once(spark):
    links = spark.createDataFrame([(0, "FREEDOM", 7, "en_prueba", 2), (5, "FREEDOM", 7, "manual", 3), (0, "TIBET", 8, "manual", 1)], "provider_id int, variety string, article_id int, status string, uses int")
    owners = spark.createDataFrame([(7, 5)], "article_id int, owner int")
    got = sorted(map(tuple, records.merge_orphans(links, owners, ["manual", "en_prueba"]).collect()))
    assert got == [(0, "TIBET", 8, "manual", 1), (5, "FREEDOM", 7, "manual", 5)]


def test_likeness_and_names(spark):
    df = spark.createDataFrame([("RED ROSE", "RED ROSE"), ("ROSE", "RED ROSE"), ("RED TULIP", "RED ROSE"), ("A", "B")], "a string, b string")
    assert [r[0] for r in df.select(reports.likeness(F.col("a"), F.col("b"))).collect()] == [100, 100, 42, 0]
    one = spark.createDataFrame([("ROSA EC FREED", "ROSA EC FREEDOM", 50, 25, "X")], "n string, v string, s int, p int, b string")
    assert one.select(records.rebuild_name(*(F.col(c) for c in "nvspb"))).first()[0] == "ROSA EC FREEDOM 50CM 25U X"


def test_references_of_long_keys_are_those_of_the_sql(spark, tmp_path):
    """Seven digits: lpad keeps six."""
    keys = (7, 1_000_274, 1_001_460)
    spark.createDataFrame([(k, "new ring 1", "Brand#1", "SMALL", 18, 1.0) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    sql = ORACLE_SQL["free_text_filter"]
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = QUERIES["free_text_filter"](spark, str(tmp_path)).collect()
    assert {r.reference for r in got} == {"F000007", "F100027", "A100146"}
    assert sorted(map(tuple, got)) == sorted(con.sql(sql).fetchall())

"""What a user does, from text to learned links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.engine import KEY, Engine
from tallyweave.operators import registry
from tallyweave.plans import suppliers
from tallyweave.sources import files, tables

SF = "/root/testdata/sf0.001"


def test_from_text_to_links(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), tables.link_catalogue(spark, SF), registry.table(spark, suppliers.LAYOUTS), tables.provider_brands(spark, SF), tables.link_usage(spark, SF), ["BRAND#3"])
    texts = spark.createDataFrame([(1, suppliers.SAMPLES["life"][0])], "doc_id long, text string")
    detected = engine.detect(texts, [("life", "vera"), ("uma", "fiorella")]).select("doc_id", F.col("provider").alias("fmt"))
    assert engine.process(texts, detected).count() == 2
    engine.switch(["life"], False)
    assert engine.process(texts, detected).count() == 0

    lines = tables.link_lines(spark, SF)
    files.save_store(tables.link_store(spark, SF).limit(0), f"{tmp_path}/links", 0)
    first = engine.link(lines).select("line_id", "article_id", "status", "source")
    first.write.parquet(f"{tmp_path}/first")
    first = spark.read.parquet(f"{tmp_path}/first")
    assert first.count() == lines.count() and first.where("source = 'synonym'").count() == 0
    ok = first.where("status = 'ok'").select("line_id", "article_id")
    engine.tell(lines, ok, "proposal", "2024-01-01")
    engine.tell(lines, ok, "confirm", "2024-01-02")
    assert engine.learn(1).where("status = 'aprendido_confirmado'").count() > 0
    again = engine.link(lines)
    assert again.where("source = 'synonym'").count() > 0
    assert engine.relink(lines.withColumn("invoice", F.col("line_id") % 3), first.select("line_id", "article_id", "status")).count() == 3

    one, two = engine.links().orderBy(*KEY).limit(2).collect()
    change = [(*(r[k] for k in KEY), a, n) for r, a, n in ((one, "delete", None), (two, "repoint", 5), (two, "repoint", 10**9))]
    errors = engine.apply(spark.createDataFrame(change, "provider_id long, species string, variety_key string, size int, pack int, grade string, action string, new_id long"), 2).collect()
    assert [e.error for e in errors] == ["no such article"]
    now = {tuple(r[k] for k in KEY): r for r in engine.links().collect()}
    assert tuple(one[k] for k in KEY) not in now and now[tuple(two[k] for k in KEY)].article_id == 5
    # what people said outlives the next round of learning
    engine.tell(lines, ok, "proposal", "2024-01-03")
    after = {tuple(r[k] for k in KEY): r for r in engine.learn(3).collect()}
    assert tuple(one[k] for k in KEY) not in after
    assert after[tuple(two[k] for k in KEY)].article_id == 5 and after[tuple(two[k] for k in KEY)].status == "manual_confirmado"
    assert engine.kpis().count() >= 1 and engine.lookup(["bolt"]).count() > 0

from __future__ import annotations

import itertools
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyweave import streaming
from tallyweave.operators import history, invoices, layouts, learning, linking, registry, reports
from tallyweave.plans import suppliers
from tallyweave.plans.queries import QUERIES
from tallyweave.sources import tables


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def doc(spark, *lines):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")


def test_plain_layout(spark):
    t = doc(spark, "Invoice 12", "2 QB FREEDOM RED 50CM 100 0,35 35,00", "3 HB EXPLORER 60CM 1.200 0,40 480,00", "TOTAL 515,00")
    assert rows(layouts.parse(t, layouts.PLAIN), "variety", "size", "stems", "total") == [("EXPLORER", 60.0, 1200.0, 480.0), ("FREEDOM RED", 50.0, 100.0, 35.0)]


def test_parent_and_continuation_carry_the_box(spark):
    t = doc(spark, "PINK FLOYD 40CM 25 0.30 7.50", "1 QB FREEDOM 50CM 100 0.35 35.00", "TIBET 60CM 50 0.40 20.00", "1 HB MONDIAL 70CM 25 0.50 12.50", "VENDELA 50CM 25 0.20 5.00")
    assert rows(layouts.parse(t, layouts.PARENT), "line_no", "variety", "box_type", "variant") == [(0, "PINK FLOYD", None, 1), (1, "FREEDOM", "QB", 0), (2, "TIBET", "QB", 1), (3, "MONDIAL", "HB", 0), (4, "VENDELA", "HB", 1)]


def test_look_around(spark):
    t = doc(spark, "1 QB FREEDOM 50CM 100 0.35 35.00", "LABEL: ROJO", "1 QB TIBET 50CM 100 0.35 35.00")
    got = {r.variety: r.label for r in layouts.parse(t, layouts.LABEL_BELOW).collect()}
    assert got == {"FREEDOM": "ROJO", "TIBET": None}
    above = doc(spark, "FREEDOM RED", "50CM 100 0.35 35.00")
    assert rows(layouts.parse(above, layouts.VARIETY_ABOVE), "variety", "stems") == [("FREEDOM RED", 100.0)]


def test_normaliser_runs_first(spark):
    noisy = layouts.Template("ocr", layouts.PLAIN.variants, numbers=layouts.PLAIN.numbers, normalise=((r"\|", ""), (r"\s+", " "), ("(?<=[0-9]O{0,3})O", "0")))
    assert rows(layouts.parse(doc(spark, "2 | QB FREEDOM  5OCM 1OO 0.35 35.00"), noisy), "size", "stems") == [(50.0, 100.0)]


def test_size_grid(spark):
    grid = spark.createDataFrame([("A", 0, 10, 5), ("B", 0, 0, 0)], "variety string, s40 int, s50 int, s60 int")
    assert rows(layouts.unpivot_sizes(grid, ["s40", "s50", "s60"]), "variety", "size", "stems") == [("A", "s50", 10), ("A", "s60", 5)]


def test_fuzzy_equals_difflib(spark):
    names = ["FREEDOM", "FREEDOM RED", "EXPLORER", "TIBET", "MONDIAL", "MONDIALL", "X"]
    queries = ["FREDOM", "MONDYAL", "TIBETT", "ZZZ", "FREDOM"]
    n = spark.createDataFrame([("p", x) for x in names] + [("q", "FREDOM")], "pool string, name string")
    q = spark.createDataFrame([("p", x) for x in queries], "pool string, query string")
    got = {(r["query"], r["name"]): (r.ratio, r.place) for r in linking.fuzzy(q, n).collect()}
    for a in set(queries):
        want = sorted(((-round(SequenceMatcher(None, a, b).ratio(), 3), b) for b in names if round(SequenceMatcher(None, a, b).ratio(), 3) >= 0.4))[:5]
        assert [(k[1], v) for k, v in sorted(got.items(), key=lambda x: x[1][1]) if k[0] == a] == [(b, (-r, i + 1)) for i, (r, b) in enumerate(want)]


def test_asof_ties_and_orphans(spark):
    log = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "confirm", 0.1, 5), (2, "2024-01-02 00:00:00", 1, "proposal", 0.2, 6), (3, "2024-01-02 00:00:00", 1, "confirm", 0.3, 7), (4, "2024-01-01 00:00:00", 2, "proposal", 0.4, 8), (5, "2024-01-03 00:00:00", 1, "correct", 0.5, 9)], "event_id long, ts string, key long, kind string, confidence double, article_id int").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert rows(history.asof(log), "event_id", "proposal_id") == [(1, None), (3, 2), (5, 2)]


def test_states_of_links(spark):
    events = {1: ["proposal"], 2: ["proposal", "proposal"], 3: ["proposal", "correct"], 4: ["correct", "correct"], 5: ["correct", "correct", "confirm"], 6: ["confirm", "correct"], 7: ["confirm", "correct", "correct", "proposal"]}
    log = spark.createDataFrame([(10 * k + i, i, k, e, 0.5, 1) for k, es in events.items() for i, e in enumerate(es)], "event_id long, ts int, key long, kind string, confidence double, article_id int")
    want = {1: "aprendido_en_prueba", 2: "aprendido_confirmado", 3: "ambiguo", 4: "rechazado", 5: "rechazado", 6: "ambiguo", 7: "rechazado"}
    assert {r.key: r.status for r in history.fold_events(log).collect()} == want


def test_gold_lines_take_what_is_left(spark):
    def of(*rows):
        return spark.createDataFrame([(1, *r) for r in rows], "doc_id long, line_no int, variety string, size int, stems int")

    gold = of((1, "FREEDOM", 50, 100), (2, "FREEDOM", 50, 100), (3, "RED", 60, 25), (4, "TIBET", 40, 25))
    found = of((1, "FREEDOM", 50, 100), (2, "FREEDOM", 50, 75), (3, "RED NAOMI", 60, 25), (9, "OTHER", 10, 1))
    got = sorted(((r.gold_no, r.found_no, r.points) for r in learning.align(gold, found).collect()), key=str)
    assert got == sorted([(1, 1, 15), (2, 2, 13), (3, 3, 10), (4, None, None), (None, 9, None)], key=str)


def test_layouts_have_samples_and_odd_lines_give_no_rows(spark):
    assert {x.name for x in suppliers.LAYOUTS} == set(suppliers.SAMPLES) and len(suppliers.LAYOUTS) == 67
    table = registry.table(spark, suppliers.LAYOUTS)
    odd = [None, "", " ", "TOTAL", "1", "x " * 5000, "$ 1.0", "(" * 50]
    lines = spark.createDataFrame([(1, x.name, i, s) for x in suppliers.LAYOUTS for i, s in enumerate(odd)] + [(2, "unknown", 0, "1 HB FREEDOM 50 25 300 0.30 90.00")], "doc_id long, fmt string, line_no int, line string")
    assert registry.parse(lines, table).count() == 0
    on = registry.activate(table, ["life"], False)
    text = suppliers.SAMPLES["life"][0].split("\n")
    lines = spark.createDataFrame([(1, "life", i, s) for i, s in enumerate(text)], "doc_id long, fmt string, line_no int, line string")
    assert registry.parse(lines, table).count() == 2 and registry.parse(lines, on).count() == 0


def test_rescue_leaves_out_what_was_parsed(spark):
    t = doc(spark, "ROSE FREEDOM 50 12.00", "ROSE TIBET 60 13.00", "TOTAL ROSE 25.00", "ROSE 1", "ROSE EXPLORER 14.00")
    parsed = spark.createDataFrame([(1, "ROSE FREEDOM 50 12.00", ""), (1, "other", "tibet")], "doc_id long, raw string, variety string")
    assert rows(invoices.rescue(t, parsed, r"\bROSE\b", r"\bTOTAL\b", r"\d+\.\d{2}"), "raw") == [("ROSE EXPLORER 14.00",)]


def test_order_of_input_changes_nothing(spark):
    lines, articles = tables.requests(spark, "/root/testdata/sf0.001"), tables.articles(spark, "/root/testdata/sf0.001")
    decide = lambda a, b: linking.decide(a, linking.scored(linking.pairs(linking.candidates(a, b), a, b)))
    assert rows(decide(lines, articles), "line_id", "article_id", "score", "status") == rows(decide(lines.orderBy(F.rand(1)).repartition(7), articles.repartition(3)), "line_id", "article_id", "score", "status")


@pytest.mark.parametrize(("operator", "key"), [(streaming.windows, "start"), (streaming.sessions, "start")])
def test_stream_equals_batch(spark, tmp_path, operator, key):
    """A last late event moves the watermark past all others, so that all windows are closed."""
    log = tables.decisions(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    end = log.limit(1).withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    log.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = operator(stream).writeStream.format("memory").queryName(f"t_{operator.__name__}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    end.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = spark.table(f"t_{operator.__name__}")
    want = operator(log)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)


def test_split_and_group(spark):
    base = [(1, 1, 10, 5, "A/B", 25, 3, 10.01, "HB", "raw"), (1, 2, 11, 5, "A/B", 10, 1, 4.0, "MIX", "box"), (1, 3, 12, 5, "C", 5, 1, 2.0, "MIX", "box")]
    lines = spark.createDataFrame(base, "invoice long, line_no int, article_id long, provider_id long, variety string, stems int, bunches int, line_total double, box_type string, raw string").withColumn("amount", F.col("line_total").cast("decimal(18,2)"))
    assert rows(invoices.split_mixed(lines), "line_no", "variety", "stems", "line_total") == [(1, "A", 12, 5.01), (1, "B", 12, 5.01), (2, "A/B", 10, 4.0), (3, "C", 5, 2.0)]
    assert rows(invoices.group_boxes(lines), "position", "n_lines", "stems", "line_total")[1] == (2, 2, 15, 6.0)


def broadcast_scans(plan):
    """Joins of a plan that would send a table read from files through the driver; tables of a row a size (mixto_id) are none."""
    nodes = [(re.match(r"[ :+-]*", x).end(), x) for x in plan.splitlines() if x.strip()]
    found = []
    for i, (depth, line) in enumerate(nodes):
        if "BroadcastHashJoin" not in line:
            continue
        below = list(itertools.takewhile(lambda n: n[0] > depth, nodes[i + 1 :]))
        first = next(k for k in range(1, len(below)) if below[k][0] == below[0][0])
        build = below[first:] if "BuildRight" in line else below[:first]
        if any("FileScan" in x for _, x in build) and not any("mixto_id" in x for _, x in build):
            found.append(line)
    return found


@pytest.mark.parametrize("name", ["evidence_scores", "link_decisions", "suggest_candidates", "alternatives", "linker_scores", "linker_decisions"])
def test_tables_that_grow_are_not_broadcast(spark, name):
    """Spark guesses a table's size from compressed files: a million articles came through the driver."""
    assert not broadcast_scans(QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString())


def test_best_articles_by_equal_columns(spark):
    """Against all pairs: nulls are equal to nothing, and an article counts once with all its points."""
    k = range(240)
    names = ["HOT RING", "HOT ROD", "HOT", "COLD RING", None]
    a = spark.createDataFrame([(i, names[i * 7 % 5], [None, 10, 20, 30][i % 4], i % 3, "AB"[i % 2]) for i in k], "id long, variety string, size int, pack int, brand string")
    q = spark.createDataFrame([(i, names[i % 5], [10, None, 30][i % 3], [0, 1, None][i % 7 % 3], [None, "A", "B"][i % 11 % 3]) for i in k], "line_id long, variety string, size int, pack int, brand string")
    got = rows(reports.alternatives(q, a), "line_id", "place", "article_id", "points")
    want = []
    for x in q.collect():
        pairs = []
        for y in a.collect():
            if x.variety is None or y.variety is None or x.variety.split()[0] != y.variety.split()[0]:
                continue
            points = 10 if x.variety == y.variety else 3 if x.variety in y.variety or y.variety in x.variety else 0
            pairs.append((-(points + sum(w for c, w in (("size", 5), ("pack", 3), ("brand", 2)) if x[c] is not None and x[c] == y[c])), y.id))
        want += [(x.line_id, n + 1, i, -p) for n, (p, i) in enumerate(sorted(p for p in pairs if p[0] <= -5)[:5])]
    assert got == sorted(want)

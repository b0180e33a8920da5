"""Evaluation of parsers and links, and what unknown layouts teach: fingerprints, clusters, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks

# Weight of each kind of fault and of how severe it is.
FAULT_WEIGHT = {"E1_PARSE_ZERO": 10, "E2_PARSE_PARTIAL": 7, "E3_LAYOUT_COORDS": 8, "E4_OCR_BAD": 6, "E5_TOTAL_HEADER": 2, "E6_MATCH_WRONG": 9, "E7_SYNONYM_DRIFT": 5, "E8_AMBIGUOUS_LINK": 4, "E9_VALIDATION_FAIL": 3, "E10_PROVIDER_COLLISION": 1}
SEVERITY = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def rollup(lines: DataFrame) -> DataFrame:
    """Metrics of each provider and, with a null provider, of all; with the share that needs nobody."""
    checked = lines.withColumn("errors", checks.line_errors()).withColumn("lane", checks.review_lane(F.col("errors")))
    s = F.col("match_status")
    m = checked.rollup("provider_id").agg(
        F.count(F.lit(1)).alias("total_parsed"), F.count_if(F.col("extraction_source") == "rescue").alias("total_rescued"), F.count_if(s == "ok").alias("ok_lines"), F.count_if(s == "ambiguous_match").alias("ambiguous_lines"),
        F.count_if(s == "sin_match").alias("sin_match_lines"), F.count_if(F.col("lane") == "auto").alias("auto_lines"), F.count_if(F.size("errors") > 0).alias("error_lines"),
    )
    linkable = F.col("ok_lines") + F.col("ambiguous_lines")
    return m.withColumn("auto_rate", F.coalesce(F.round(F.try_divide(F.col("auto_lines").cast("double"), linkable), 3), F.lit(0.0)))


def verdicts(lines: DataFrame, balanced: DataFrame) -> DataFrame:
    """A word for each provider; its samples are the invoices with lines of it."""
    samples = lines.groupBy("provider_id", "invoice").agg(F.count_if(F.col("extraction_source") != "rescue").alias("parsed"), F.count_if(F.col("extraction_source") == "rescue").alias("rescued"))
    j = samples.join(balanced.select("invoice", "header_ok"), "invoice", "left")
    m = j.groupBy("provider_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("header_ok").isNotNull()).alias("detected"), F.count_if((F.col("parsed") + F.col("rescued")) > 0).alias("parsed_any"), F.count_if("header_ok").alias("totals_ok"), F.sum("parsed").alias("total_parsed"), F.sum("rescued").alias("total_rescued"))
    return m.withColumn("verdict", checks.verdict())


def fault_samples(lines: DataFrame, balanced: DataFrame) -> DataFrame:
    """A row for each provider's invoice: parsed and rescued lines, least confidence, source, header_ok."""
    s = lines.groupBy("provider_id", "invoice").agg(
        F.count_if(F.col("extraction_source") != "rescue").alias("parsed"), F.count_if(F.col("extraction_source") == "rescue").alias("rescued"), F.min("extraction_confidence").alias("confidence"),
        F.count_if(F.col("match_status") == "ambiguous_match").alias("ambiguous"), F.count_if(F.col("match_status") == "sin_match").alias("unmatched"), F.count_if(F.size(checks.line_errors()) > 0).alias("invalid"),
        F.count_if((F.col("match_status") == "ok") & (F.col("link_confidence") < 0.2)).alias("wrong"), F.count_if((F.col("match_method") != "exact") & (F.col("match_confidence") < 0.85)).alias("weak"), F.count_if(F.col("candidate_margin") < 0.04).alias("ties"),
    )
    scanned = F.when(F.col("confidence") < 0.7, "ocr").otherwise("native")
    return s.withColumn("source", scanned).join(balanced.select("invoice", "header_ok"), "invoice", "left")


def taxonomy(samples: DataFrame, formats: DataFrame, rates: DataFrame) -> DataFrame:
    """Faults E1 to E10 of each provider, how severe each is, how many samples or lines it touches, its priority, and whether it's the provider's dominant one.

    Providers without a fault are CLEAN. ``rates``: provider_id, auto_rate; those that mostly need nobody are less urgent.

    ``samples``: what ``fault_samples`` gives. ``formats``: provider_id, fmt; a layout that several troubled providers share is a fault too.
    """
    c, n_of = F.col, lambda cond: F.count_if(cond)
    shared = formats.join(formats.groupBy("fmt").agg(F.count(F.lit(1)).alias("sharing")), "fmt").select("provider_id", "sharing")
    m = samples.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("n"), n_of(c("parsed") == 0).alias("zero"), n_of((c("parsed") == 0) & (c("source") == "native")).alias("native_zero"), n_of((c("source") == "ocr") & ((c("parsed") == 0) | (c("confidence") < 0.6))).alias("bad_ocr"),
        n_of((c("parsed") > 0) & ~F.coalesce("header_ok", F.lit(False))).alias("bad_total"), *[F.sum(x).alias(x) for x in ("parsed", "rescued", "ambiguous", "unmatched", "invalid", "wrong", "weak", "ties")],
    ).join(shared, "provider_id", "left")
    steps = lambda x, high, medium: F.when(x >= high, "HIGH").when(x >= medium, "MEDIUM").otherwise("LOW")
    ratio = F.coalesce(F.try_divide(c("rescued").cast("double"), c("parsed") + c("rescued")), F.lit(0.0))
    weak = F.coalesce(F.try_divide(c("weak").cast("double"), c("parsed")), F.lit(0.0))
    one = lambda name, when, severity, impact: F.when(when, F.struct(F.lit(name).alias("category"), severity.alias("severity"), impact.cast("long").alias("impact")))
    found = F.array(
        one("E1_PARSE_ZERO", c("zero") > 0, F.when(c("zero") >= 0.5 * c("n"), "HIGH").otherwise("MEDIUM"), c("zero")),
        one("E2_PARSE_PARTIAL", (c("rescued") > 0) & (c("parsed") > 0), F.when(ratio > 0.3, "HIGH").when(ratio > 0.1, "MEDIUM").otherwise("LOW"), c("rescued")),
        one("E3_LAYOUT_COORDS", c("native_zero") > 0, steps(c("native_zero"), 2, 1), c("native_zero")),
        one("E4_OCR_BAD", c("bad_ocr") > 0, steps(c("bad_ocr"), 2, 1), c("bad_ocr")),
        one("E5_TOTAL_HEADER", c("bad_total") > 0, F.when(c("bad_total") <= 0.3 * c("n"), "LOW").otherwise("MEDIUM"), c("bad_total")),
        one("E6_MATCH_WRONG", c("wrong") >= 2, steps(c("wrong"), 5, 2), c("wrong")),
        one("E7_SYNONYM_DRIFT", (c("weak") >= 3) & (weak >= 0.2), steps(c("weak"), 10, 5), c("weak")),
        one("E8_AMBIGUOUS_LINK", (c("ambiguous") >= 2) | (c("ties") >= 3), steps(c("ambiguous"), 5, 2), c("ambiguous")),
        one("E9_VALIDATION_FAIL", c("invalid") > 0, steps(c("invalid"), 5, 2), c("invalid")),
        one("E10_PROVIDER_COLLISION", (F.coalesce("sharing", F.lit(0)) >= 2) & (c("unmatched") > 0), F.lit("LOW"), F.lit(0)),
    )
    value = lambda table, key: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key), F.lit(1))
    clean = F.array(F.struct(F.lit("CLEAN").alias("category"), F.lit("NONE").alias("severity"), F.lit(0).cast("long").alias("impact")))
    found = F.filter(found, lambda f: f.isNotNull())
    x = m.join(rates, "provider_id", "left").select("provider_id", "auto_rate", F.explode(F.when(F.size(found) > 0, found).otherwise(clean)).alias("f")).select("provider_id", "auto_rate", "f.*")
    base = value(SEVERITY, c("severity")) * value(FAULT_WEIGHT, c("category")) + c("impact") * 0.5
    x = x.withColumn("priority", F.when(c("category") == "CLEAN", 0.0).otherwise(F.round(base * F.when(c("auto_rate") >= 0.85, 0.4).when(c("auto_rate") >= 0.70, 0.7).otherwise(1.0), 3)))
    order = [F.desc("priority"), "category"]
    dominant = F.row_number().over(Window.partitionBy("provider_id").orderBy(*order)) == 1
    return x.withColumn("dominant", dominant).select("provider_id", "category", "severity", "impact", "priority", "dominant")


def align(gold: DataFrame, found: DataFrame, least: int = 5) -> DataFrame:
    """One-to-one pairs of gold and found lines of a document: each gold line, in order, takes the best found line that is left.

    ``gold`` and ``found``: doc_id, line_no, variety, size, stems. Affinity comes from variety (10 if equal, 5 if one holds the other), size
    (3, or 1 if at most 10 off) and stems (2); ties go to the earlier found line. Lines that are left over have a null partner.
    """
    gv, fv = F.upper(F.trim("gv")), F.upper(F.trim("variety"))
    g = gold.select("doc_id", F.col("line_no").alias("gold_no"), F.col("variety").alias("gv"), F.col("size").alias("gs"), F.col("stems").alias("gt"))
    f = found.select("doc_id", F.col("line_no").alias("found_no"), "variety", "size", "stems")
    holds = (gv != "") & (fv != "") & (F.contains(gv, fv) | F.contains(fv, gv))
    points = F.when(gv == fv, 10).when(holds, 5).otherwise(0) + F.when(F.col("gs") == F.col("size"), 3).when((F.col("gs") != 0) & (F.col("size") != 0) & (F.abs(F.col("gs") - F.col("size")) <= 10), 1).otherwise(0) + F.when(F.col("gt") == F.col("stems"), 2).otherwise(0)
    # a document's lines are few; documents are many
    j = g.join(f, "doc_id").select("doc_id", "gold_no", F.struct((-points).alias("minus"), "found_no").alias("o")).where(-F.col("o.minus") >= least)
    by_line = j.groupBy("doc_id", "gold_no").agg(F.array_sort(F.collect_list("o")).alias("options"))
    by_doc = by_line.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("gold_no", "options"))).alias("lines"))
    free = "get(filter(x.options, o -> not exists(taken, p -> p.found_no = o.found_no)), 0)"
    empty = "cast(array() as array<struct<gold_no: int, found_no: int, points: int>>)"
    step = f"if({free} is null, taken, array_append(taken, named_struct('gold_no', x.gold_no, 'found_no', {free}.found_no, 'points', -{free}.minus)))"
    pairs = by_doc.select("doc_id", F.explode(F.expr(f"aggregate(lines, {empty}, (taken, x) -> {step})")).alias("p")).select("doc_id", "p.*")
    nothing = F.lit(None).cast("int")
    lost = g.select("doc_id", "gold_no").join(pairs, ["doc_id", "gold_no"], "left_anti").select("doc_id", "gold_no", nothing.alias("found_no"), nothing.alias("points"))
    extra = f.select("doc_id", "found_no").join(pairs, ["doc_id", "found_no"], "left_anti").select("doc_id", nothing.alias("gold_no"), "found_no", nothing.alias("points"))
    return pairs.unionByName(lost).unionByName(extra)


def gold_metrics(gold: DataFrame, found: DataFrame, fields: list[str], tolerance: float = 0.02) -> DataFrame:
    """How many gold lines agree with the found ones: a row for each field, for the link (article_id) and for whole lines (all fields and the link).

    ``gold`` and ``found``: doc_id, line_no, variety, size, stems, the fields and article_id. Amounts (``line_total``) may differ by the
    tolerance; a gold line without a partner agrees in nothing; a link counts only where gold has one.
    """
    pairs = align(gold, found).where("gold_no is not null")
    cols = list(dict.fromkeys([*fields, "article_id"]))
    g = gold.select("doc_id", F.col("line_no").alias("gold_no"), *[F.col(c).alias(f"g_{c}") for c in cols])
    s = found.select("doc_id", F.col("line_no").alias("found_no"), *[F.col(c).alias(f"f_{c}") for c in cols])
    j = g.join(pairs, ["doc_id", "gold_no"]).join(s, ["doc_id", "found_no"], "left")
    near = lambda a, b: F.when(a == 0, b == 0).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.lit(0.01)) <= tolerance)
    same = {c: F.coalesce(near(F.col(f"g_{c}"), F.col(f"f_{c}")) if c == "line_total" else F.upper(F.col(f"g_{c}").cast("string")) == F.upper(F.col(f"f_{c}").cast("string")), F.lit(False)) for c in cols}
    whole = F.lit(True)
    for c in cols:
        whole = whole & same[c]
    linked = F.coalesce(F.col("g_article_id"), F.lit(0)) > 0
    what = [(c, F.lit(True), same[c]) for c in fields] + [("link", linked, same["article_id"]), ("line", F.lit(True), whole)]
    counts = j.agg(*[x for n, used, ok in what for x in (F.count_if(used).alias(f"n_{n}"), F.count_if(used & ok).alias(f"ok_{n}"))])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"n_{n}").alias("n"), F.col(f"ok_{n}").alias("ok")) for n, _, _ in what])).alias("x")).select("x.*")
    return rows.withColumn("accuracy", F.round(F.try_divide(F.col("ok").cast("double"), F.col("n")), 4))


def fingerprints(text_lines: DataFrame, data_line: str) -> DataFrame:
    """Structure of a document from its lines: zones before and after the data lines, separator, fields, confidence, hash.

    ``text_lines``: doc_id, line_no (from 0), line.
    """
    line = F.trim(F.col("line"))
    t = text_lines.withColumn("is_data", line.rlike(data_line) & (F.length(line) >= 10)).withColumn("n_fields", F.size(F.split(line, r"\s+"))).withColumn("pipes", F.length("line") - F.length(F.replace("line", F.lit("|"))))
    d = t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("is_data").alias("n_data"), F.coalesce(F.min(F.when(F.col("is_data"), F.col("line_no"))), F.lit(0)).cast("long").alias("header_lines"),
        (F.count(F.lit(1)) - 1 - F.coalesce(F.max(F.when(F.col("is_data"), F.col("line_no"))), F.count(F.lit(1)) - 1)).alias("footer_lines"),
        F.coalesce(F.sum(F.when(F.col("is_data"), F.col("pipes"))), F.lit(0)).alias("pipes"), F.coalesce(F.floor(F.median(F.when(F.col("is_data"), F.col("n_fields")))), F.lit(0)).alias("n_fields"),
    )
    separator = F.when(F.col("pipes") > F.col("n_data"), "pipe").when(F.col("n_data") > 0, "spaces").otherwise("")
    points = F.when((F.col("separator") != "") & (F.col("n_fields") >= 4), 20).otherwise(0) + F.when(F.col("n_data") >= 3, 20).when(F.col("n_data") >= 1, 10).otherwise(0) + F.when((F.col("header_lines") >= 3) & (F.col("footer_lines") >= 1), 10).otherwise(0)
    d = d.withColumn("separator", separator).withColumn("points", points)
    key = F.concat_ws("|", "separator", F.col("n_fields").cast("string"), (F.col("n_data") >= 3).cast("string"))
    return d.select("doc_id", "n_lines", "n_data", "header_lines", "footer_lines", "separator", "n_fields", "points", F.substring(F.md5(key), 1, 12).alias("structure"))


def clusters(prints: DataFrame) -> DataFrame:
    """Documents of the same structure; members are held against the first one: number of fields within 2."""
    base = prints.groupBy("structure").agg(F.min(F.struct("doc_id", "n_fields")).alias("base"))
    j = prints.join(base, "structure").withColumn("fits", F.abs(F.col("n_fields") - F.col("base.n_fields")) <= 2)
    n = F.count_if("fits")
    confidence = F.when(n >= 5, 1.0).when(n >= 3, 0.8).when(n >= 2, 0.5).otherwise(0.3)
    return j.groupBy("structure").agg(F.first("base.doc_id").alias("first_doc"), n.alias("n_docs"), F.round(F.avg("points"), 3).alias("mean_points"), confidence.alias("confidence"))


def infer_patterns(texts: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Of a field's patterns the one that most documents' first 2,000 characters match: field, pattern number, hits, share."""
    head = F.substring("text", 1, 2000)
    hits = texts.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(head.rlike(p)).alias(f"p{i}") for i, (_, p) in enumerate(patterns)])
    rows = F.array(*[F.struct(F.lit(field).alias("field"), F.lit(i).alias("pattern_no"), F.col(f"p{i}").alias("hits")) for i, (field, _) in enumerate(patterns)])
    x = hits.select("n", F.explode(rows).alias("x")).select("n", "x.*")
    best = x.groupBy("field").agg(F.max(F.struct("hits", (-F.col("pattern_no")).alias("m"), "n")).alias("b"))
    return best.select("field", (-F.col("b.m")).cast("int").alias("pattern_no"), "b.hits", F.round(F.col("b.hits") / F.col("b.n"), 4).alias("share"))


def column_types(cells: DataFrame) -> DataFrame:
    """What a column holds, by the share of its cells: position, n, ratios, kind."""
    v = F.col("cell")
    whole, decimal = v.rlike("^[0-9]+$"), v.rlike(r"^[0-9]+[.,][0-9]+$")
    word = v.rlike(r"^[A-Za-z.,]+$")
    m = cells.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(whole) / F.count(F.lit(1)), 4).alias("whole"), F.round(F.count_if(decimal) / F.count(F.lit(1)), 4).alias("decimal"), F.round(F.count_if(word) / F.count(F.lit(1)), 4).alias("word"), F.round(F.avg(F.length("cell")), 3).alias("mean_length"))
    return m.withColumn("kind", F.when(F.col("decimal") > 0.7, "price").when(F.col("whole") > 0.7, "count").when(F.col("word") > 0.7, "text").otherwise("mixed"))


def validate_rules(values: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of plausible values of each field, a quarter point for each check that passes.

    ``values``: field, value (double, null if it wasn't read).
    """
    low = F.create_map(*[F.lit(x) for k, (a, _) in ranges.items() for x in (k, float(a))])
    high = F.create_map(*[F.lit(x) for k, (_, b) in ranges.items() for x in (k, float(b))])
    ok = F.col("value").between(F.try_element_at(low, F.col("field")), F.try_element_at(high, F.col("field")))
    m = values.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_read"), F.count_if(ok).alias("n_plausible"), F.countDistinct("value").alias("n_distinct"))
    share = F.when(F.col("n_read") >= 0.5 * F.col("n"), 0.25).otherwise(0.0) + F.when(F.col("n_plausible") >= 0.7 * F.col("n_read"), 0.25).otherwise(0.0) + F.when(F.col("n_distinct") > 1, 0.25).otherwise(0.0) + F.when(F.col("n") >= 3, 0.25).otherwise(0.0)
    d = m.withColumn("score", share)
    return d.withColumn("decision", F.when(F.col("score") >= 0.85, "active").when(F.col("score") >= 0.50, "active, review").when(F.col("score") >= 0.25, "review").otherwise("reject"))

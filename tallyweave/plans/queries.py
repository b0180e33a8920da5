"""Every registered query: an operator applied to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import streaming
from ..functions import text
from ..operators import grids, history, invoices, layouts, learning, linker, linking, readers, records, registry, reports
from ..sources import files
from ..sources import tables as t
from . import printed, suppliers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Patterns of providers in texts, and brands kept by hand.
PROVIDER_PATTERNS = [("north", "thnt"), ("north", "Nding"), ("south", "einver"), ("south", "schen"), ("east", "mente"), ("west", "eaux"), ("west", "tionre"), ("centre", "license")]
MANUAL_BRANDS = [(1, "HOUSE"), (2, "HOUSE"), (2, "GARDEN")]
SEARCHES = ["F000012", "f0001", "red widget", "small 25U", "zzz"]
HEADER_PATTERNS = [("total", r"[0-9]+ [0-9]+"), ("total", "[0-9]{4}"), ("contact", "@"), ("contact", r"\+[0-9]"), ("license", "(?i)license"), ("license", "Version")]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def invoice_balance(spark, d):
    return invoices.balance(t.lines(spark, d), t.headers(spark, d))


@query
def header_repair(spark, d):
    return invoices.repair_totals(t.lines(spark, d), t.headers(spark, d))


@query
def line_checks(spark, d):
    return invoices.line_findings(t.lines(spark, d))


@query
def review_lanes(spark, d):
    return invoices.lanes(t.lines(spark, d))


@query
def invoice_kpis(spark, d):
    return invoices.kpis(t.lines(spark, d))


@query
def batch_summary(spark, d):
    return invoices.batch_summary(t.lines(spark, d), t.headers(spark, d))


@query
def needs_review_variants(spark, d):
    return invoices.review_variants(t.lines(spark, d))


def _boxed(spark, d) -> DataFrame:
    """Lines with their variety: every third article is a mixed pair, every seventh a box line."""
    name = F.upper("p_name")
    part = t.table(spark, d, "part").select(
        F.col("p_partkey").alias("article_id"), F.when(F.col("p_partkey") % 3 == 0, F.replace(name, F.lit(" "), F.lit("/"))).otherwise(name).alias("variety"),
        F.when(F.col("p_partkey") % 7 == 0, "MIX").otherwise("HB").alias("box_type"), name.alias("raw"), F.col("p_size").alias("size"),
    )
    return t.lines(spark, d).join(part, "article_id")


@query
def split_mixed(spark, d):
    return invoices.split_mixed(_boxed(spark, d))


@query
def group_mixed_boxes(spark, d):
    return invoices.group_boxes(_boxed(spark, d))


@query
def reclassify_assorted(spark, d):
    out = invoices.reclassify(_boxed(spark, d), r"^(MIX|MIXED|ASSORTED|SMALL .*|HOT.RING)$")
    return out.groupBy("match_status").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("amount").cast("double").alias("total"))


@query
def rescue_lines(spark, d):
    lines = t.text_lines(spark, d)
    parsed = lines.where("line_no = 0").select("doc_id", F.col("line").alias("raw"), F.substring_index("line", " ", 1).alias("variety"))
    return invoices.rescue(lines, parsed, r"\b(the|de|der|la)\b", r"\b(licensed|version|token)\b", "[0-9]")


@query
def order_sheets(spark, d):
    lines = t.lines(spark, d)
    existing = lines.where("line_no = 1 and stems > 40").select("invoice", "provider_id").distinct()
    return invoices.order_sheets(lines, t.headers(spark, d), existing)


@query
def upsert_latest(spark, d):
    return invoices.upsert_latest(t.decisions(spark, d).select("key", "kind", "confidence", "ts", "event_id"), "key", ["ts", "event_id"]).select("key", "kind", "confidence", "event_id")


@query
def page_confidence(spark, d):
    pages = t.text_lines(spark, d).select("doc_id", F.col("line_no").alias("page_no"), F.col("line").alias("text"), (F.lit(0.5) + (F.col("line_no") % 5) / 10).alias("confidence"))
    return invoices.page_confidence(pages)


@query
def canonical_keys(spark, d):
    return t.articles(spark, d).select("id", text.match_key(F.col("family"), F.concat_ws(". ", "variety", "brand"), F.col("size"), F.col("pack"), F.lit("a1")).alias("match_key"))


@query
def expected_names(spark, d):
    c = F.col
    species = F.element_at(F.array(*map(F.lit, ("ROSES", "CARNATIONS", "HYDRANGEAS", "ALSTROEMERIA", "GYPSOPHILA", "CHRYSANTHEMUM", "OTHER"))), (c("id") % 7 + 1).cast("int"))
    origin = F.when(c("id") % 2 == 0, "EC").otherwise("COL")
    size = F.when(c("id") % 11 == 0, 0).otherwise(c("size")).cast("int")
    return t.articles(spark, d).select("id", text.expected_name(species, c("variety"), size, c("pack"), F.when(c("id") % 3 == 0, "").otherwise("Fancy"), origin).alias("expected"))


@query
def color_translation(spark, d):
    return t.articles(spark, d).select("id", text.translate_colors(F.col("variety")).alias("translated"), text.fold(F.concat(F.lit("  é"), F.col("variety"), F.lit(" ñ  b"))).alias("folded"))


@query
def number_parsing(spark, d):
    """Amounts written in three notations and read again, with the printed total of a made-up text."""
    c = F.col("o_totalprice").cast("decimal(18,2)")
    us = F.format_number(c, 2)
    eu = F.translate(us, ",.", ".,")
    o = t.table(spark, d, "orders")
    total = F.concat(F.lit("Line 1\nGrand Total: $ "), us, F.lit("\nthanks"))
    return o.select("o_orderkey", text.number(us).cast("double").alias("us"), text.number(eu).cast("double").alias("eu"), text.number(F.replace(us, F.lit(","))).cast("double").alias("plain"), text.printed_total(total).cast("double").alias("printed"))


@query
def provider_detection(spark, d):
    return linking.detect(t.table(spark, d, "documents").select("doc_id", "text"), PROVIDER_PATTERNS)


def _tokens(spark, d) -> DataFrame:
    part = t.table(spark, d, "part").select(F.col("p_partkey").alias("article_id"), F.upper(F.substring_index("p_name", " ", -1)).alias("token"))
    return t.lines(spark, d).select("provider_id", "article_id").join(part, "article_id")


@query
def brand_mining(spark, d):
    return linking.mine_brands(_tokens(spark, d))


@query
def own_brands(spark, d):
    manual = spark.createDataFrame(MANUAL_BRANDS, "provider_id long, brand string")
    strict = t.table(spark, d, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("provider_id"))
    return linking.own_brands(linking.mine_brands(_tokens(spark, d)), manual, strict, ["ROD", "BOLT"])


@query
def catalog_index(spark, d):
    return linking.derive(t.articles(spark, d))


@query
def synonym_lookup(spark, d):
    a = t.articles(spark, d).select(text.canonical(F.col("variety")).alias("variety_key"), "size", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("pack")).alias("pack"), "id")
    links = a.groupBy("variety_key", "size", "pack").agg(F.min("id").alias("article_id"))
    lines = t.requests(spark, d).select("line_id", text.canonical(F.col("variety")).alias("variety_key"), "size", "pack")
    return linking.lookup_links(lines, links).select("line_id", "found", "how")


@query
def priority_search(spark, d):
    lines, articles = t.requests(spark, d), t.articles(spark, d)
    return linking.cascade(lines.withColumn("provider_id", F.col("line_id") % 50), articles.withColumn("provider_id", F.col("id") * 7 % 50))


@query
def branded_exact_match(spark, d):
    return linking.exact_names(t.requests(spark, d), t.articles(spark, d))


@query
def rose_prefix_match(spark, d):
    return linking.prefix_names(t.requests(spark, d), t.articles(spark, d))


@query
def candidate_union_dedupe(spark, d):
    return linking.candidates(t.requests(spark, d), t.articles(spark, d))


def _pairs(spark, d, viable: bool = False) -> DataFrame:
    lines, articles = t.requests(spark, d), t.articles(spark, d)
    return linking.pairs(linking.candidates(lines, articles, viable), lines, articles)


@query
def hard_vetoes(spark, d):
    return _pairs(spark, d).select("line_id", "article_id", F.array_join(linking.vetoes(), ",").alias("vetoes"))


def _graded(spark, d) -> DataFrame:
    return linking.scored(_pairs(spark, d, viable=True).where(F.size(linking.vetoes()) == 0))


@query
def evidence_scores(spark, d):
    return _graded(spark, d).select("line_id", "article_id", "source", "score")


@query
def link_decisions(spark, d):
    return linking.decide(t.requests(spark, d), _graded(spark, d))


# --- the whole linker

#: Brands that only their owners' lines may have.
LINE_PATTERNS = [r"^[A-Z]", r"[0-9]+", r"\\.$"]
LATE = "2024-01-15 00:00:00"
HARD_BRANDS = ["BRAND#3", "BRAND#9", "BRAND#15"]


def _fuzzy_hits(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The five names of the same species that are most like a line's variety, at .40 or more; each distinct variety is looked up once."""
    v = text.canonical(F.col("variety"))
    names = catalogue.groupBy(F.col("species").alias("pool"), v.alias("name")).agg(F.min("id").alias("article_id"))
    asked = lines.select("line_id", F.col("species").alias("pool"), v.alias("query"))
    best = linking.alike(asked, names).join(linking.dealt(names), ["pool", "name"])
    percent = F.floor(200 * F.col("matched") / (F.length("query") + F.length("name"))).cast("int")
    return asked.join(linking.dealt(best.select("pool", "query", "article_id", percent.alias("percent"))), ["pool", "query"]).select("line_id", "article_id", "percent")


def _gathered(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    lines, catalogue, brands = t.link_lines(spark, d), t.link_catalogue(spark, d), t.provider_brands(spark, d)
    return lines, catalogue, brands, linker.gather(lines, catalogue, t.link_store(spark, d), brands, _fuzzy_hits(lines, catalogue))


def _evidence(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines, catalogue, brands, found = _gathered(spark, d)
    return lines, catalogue, linker.evidence(linker.viable(linker.beside(found, lines, catalogue)), brands, HARD_BRANDS, t.link_usage(spark, d))


@query
def variety_strips(spark, d):
    return linker.strips(t.link_lines(spark, d)).select("line_id", "source", "ord", "variety")


@query
def linker_candidates(spark, d):
    return _gathered(spark, d)[3].select("line_id", "article_id", "source", "percent", "status")


@query
def linker_vetoes(spark, d):
    lines, catalogue, _, found = _gathered(spark, d)
    return linker.beside(found, lines, catalogue).select("line_id", "article_id", F.array_join(linker.vetoes(), ",").alias("vetoes"))


@query
def linker_scores(spark, d):
    return linker.lifted(_evidence(spark, d)[2]).select("line_id", "article_id", "source", "points", "score")


@query
def linker_decisions(spark, d):
    lines, catalogue, graded = _evidence(spark, d)
    return linker.decide(lines, linker.lifted(graded), catalogue)


@query
def levenshtein_topk(spark, d):
    names = t.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return linking.nearest_names(names, names)


@query
def fuzzy_topk(spark, d):
    a = t.articles(spark, d)
    return linking.fuzzy(a.select(F.col("family").alias("pool"), F.reverse("variety").alias("query")), a.select(F.col("family").alias("pool"), F.col("variety").alias("name")))


@query
def article_search(spark, d):
    return linking.search(t.articles(spark, d), SEARCHES)


@query
def suggest_candidates(spark, d):
    return linking.suggest(t.requests(spark, d), t.articles(spark, d))


@query
def price_reconcile(spark, d):
    return history.reconcile(t.lines(spark, d))


@query
def price_timeline(spark, d):
    return history.timeline(t.lines(spark, d), t.headers(spark, d))


@query
def provider_article_usage(spark, d):
    return history.usage(t.lines(spark, d))


@query
def shadow_asof(spark, d):
    return history.asof(t.decisions(spark, d))


@query
def shadow_accuracy(spark, d):
    return history.accuracy(t.decisions(spark, d))


@query
def shadow_backlog(spark, d):
    return history.backlog(t.decisions(spark, d))


@query
def missing_articles(spark, d):
    return history.missing_articles(t.decisions(spark, d))


@query
def synonym_fold(spark, d):
    return history.fold_events(t.decisions(spark, d))


@query
def trust_scores(spark, d):
    return history.fold_counts(t.decisions(spark, d))


@query
def synonym_audit(spark, d):
    return history.audit(t.articles(spark, d).select("variety", "size", F.col("id").alias("article_id")))


@query
def benchmark_rollup(spark, d):
    return learning.rollup(t.lines(spark, d))


@query
def provider_verdicts(spark, d):
    lines = t.lines(spark, d)
    return learning.verdicts(lines, invoices.balance(lines, t.headers(spark, d)))


@query
def error_taxonomy(spark, d):
    lines = t.lines(spark, d)
    formats = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.when(F.col("s_suppkey") % 4 == 0, "shared").otherwise(F.col("s_name")).alias("fmt"))
    return learning.taxonomy(learning.fault_samples(lines, invoices.balance(lines, t.headers(spark, d))), formats, learning.rollup(lines).where("provider_id is not null").select("provider_id", "auto_rate"))


@query
def golden_alignment(spark, d):
    b = _boxed(spark, d).select(F.col("invoice").alias("doc_id"), F.col("line_no"), "variety", "size", "stems", "amount", "provider_id", "article_id")
    one = b.groupBy("doc_id", "line_no").agg(F.min_by(F.struct("variety", "size", "stems"), F.struct("article_id", "provider_id", "amount")).alias("x")).select("doc_id", "line_no", "x.*")
    found = one.select("doc_id", (8 - F.col("line_no")).cast("int").alias("line_no"), "variety", (F.col("size") + F.col("line_no") % 2).cast("int").alias("size"), "stems")
    return learning.align(one, found)


@query
def fingerprints(spark, d):
    return learning.fingerprints(t.text_lines(spark, d), r"[0-9]|\|")


@query
def fingerprint_clusters(spark, d):
    return learning.clusters(learning.fingerprints(t.text_lines(spark, d), r"[0-9]|\|"))


@query
def rule_inference(spark, d):
    return learning.infer_patterns(t.table(spark, d, "documents").select("text"), HEADER_PATTERNS)


@query
def column_typing(spark, d):
    lines = t.text_lines(spark, d).where("line rlike '[0-9]'")
    cells = lines.select(F.posexplode(F.filter(F.split("line", "[ \t]+"), lambda w: w != "")).alias("position", "cell"))
    return learning.column_types(cells)


@query
def rule_validation(spark, d):
    lines = t.lines(spark, d)
    values = lines.select(F.explode(F.array(F.struct(F.lit("stems").alias("field"), F.col("stems").cast("double").alias("value")), F.struct(F.lit("price").alias("field"), F.col("line_total").alias("value")), F.struct(F.lit("size").alias("field"), F.when(F.col("line_no") > 5, F.col("pack").cast("double")).alias("value")))).alias("x"))
    return learning.validate_rules(values.select("x.*"), {"stems": (1, 1000), "price": (1, 50000), "size": (30, 120)})


@query
def carry_forward(spark, d):
    """Each line of a document with the last heading (a line that ends with a colon or a full stop and has at most six words) above it."""
    heads = layouts.Template("heads", ((r"^(\S+) ", {"first_word": 1}),), carried={"head": r"^((?:\S+ ){0,5}\S+[.:])$"})
    return layouts.parse(t.text_lines(spark, d), heads)


@query
def look_around(spark, d):
    """Lines with the first word of the line below and the last word of the line above."""
    near = layouts.Template("near", ((r"^(\S+)", {"first_word": 1}),), looked={"below": (r"^(\S+)", 1), "above": (r"(\S+)$", -1)})
    return layouts.parse(t.text_lines(spark, d), near)


@query
def template_rows(spark, d):
    """Invoice texts made from lines, and read again by a template with carried box types."""
    lines = _boxed(spark, d)
    row = F.format_string("%d QB %s %dCM %d %.2f %.2f", "line_no", "raw", F.col("size") + 10, "stems", F.col("line_no").cast("double"), "line_total")
    text_lines = lines.select(F.col("invoice").alias("doc_id"), F.row_number().over(Window.partitionBy("invoice").orderBy("line_no", "article_id", "provider_id", "line_total")).alias("line_no"), row.alias("line"))
    return layouts.parse(text_lines, layouts.PARENT)


@query
def layout_rows(spark, d):
    """Documents in eleven suppliers' layouts, printed from the tables and read again."""
    table = registry.table(spark, [x for x in suppliers.LAYOUTS if x.name in printed.LAYOUTS])
    return readers.read(printed.lines(spark, d), table, suppliers.ANCHORED, suppliers.GRIDS).drop("status")


@query
def link_states(spark, d):
    """The log's links, where a person deleted some keys and chose articles for others."""
    log = t.decisions(spark, d)
    kind = F.when(F.col("event_id") % 40 == 0, "delete").when(F.col("event_id") % 40 == 1, "manual").otherwise(F.col("kind"))
    return history.replay(log.select("key", "article_id", kind.alias("kind"), "ts").where("article_id is not null"))


@query
def amount_texts(spark, d):
    """Prices of lines as suppliers write them, in both notations, with spaces and signs, and read again."""
    li = t.table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    us, eu = printed.decimal(cents, 2, ".", ","), printed.decimal(cents, 2, ",", ".")
    written = F.when(F.col("l_partkey") % 4 == 0, us).when(F.col("l_partkey") % 4 == 1, eu).when(F.col("l_partkey") % 4 == 2, F.concat(F.lit("$ "), us)).otherwise(printed.decimal(cents, 2))
    keys = [F.col(a).alias(b) for a, b in (("l_orderkey", "doc_id"), ("l_linenumber", "line_no"), ("l_partkey", "key"), ("l_suppkey", "other"))]
    return li.select(*keys, text.number(written).cast("double").alias("amount"))


@query
def printed_totals(spark, d):
    """Totals of orders in the phrases that suppliers use, found in their text; a phrase without an amount gives 0."""
    o = t.table(spark, d, "orders")
    us = printed.decimal(F.round(F.col("o_totalprice") * 100).cast("long"), 2, ".", ",")
    phrases = [("TOTAL FOB 12 300.5 ", ""), ("Sub Total $ ", " net"), ("Amount Due: $ ", ""), ("INVOICE TOTAL (Dolares) ", ""), ("Total USD ", " thank you"), ("GRAND TOTAL : ", "")]
    said = [F.when(F.col("o_orderkey") % 7 == i, F.concat(F.lit(f"Invoice 12 of 3 boxes\n{a}"), us, F.lit(b))) for i, (a, b) in enumerate(phrases)]
    return o.select(F.col("o_orderkey").alias("doc_id"), text.printed_total(F.coalesce(*said, F.lit("Total USD nothing"))).cast("double").alias("total"))


@query
def size_places(spark, d):
    """Words of documents whose header names sizes at places of its own: which size a count stands below; null beyond half a column."""
    li = t.table(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    width = (20 + F.col("l_orderkey") % 15).cast("double")
    place = F.when(F.col("l_partkey") % 11 == 10, F.lit(99)).otherwise(F.col("l_partkey") % 5) * width + 300 + (F.col("l_partkey") % 7 - 3)
    words = li.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("line_no"), place.cast("double").alias("x"), F.col("l_quantity").cast("int").cast("string").alias("word"))
    sizes = F.explode(F.array(*[F.struct((300 + width * i).alias("x"), F.lit(str(40 + 10 * i)).alias("word")) for i in range(5)], F.struct(F.lit(100.0).alias("x"), F.lit("VARIETY").alias("word"))))
    heads = li.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("line_no"), sizes.alias("s")).select("doc_id", "line_no", "s.x", "s.word")
    found = grids.sized(words.unionByName(heads))
    return found.select("doc_id", "line_no", "size", F.col("word").cast("int").alias("count"))


@query
def layout_switches(spark, d):
    """Rows of the layouts that are left on after others were switched off and one on again."""
    table = registry.table(spark, [x for x in suppliers.LAYOUTS if x.name in printed.LAYOUTS])
    off = [n for n in printed.LAYOUTS if n not in ("brissas",)]
    table = registry.activate(registry.activate(table, off, False), ["uma"])
    return registry.parse(printed.lines(spark, d), table).groupBy("fmt").agg(F.count(F.lit(1)).alias("n"))


@query
def gold_metrics(spark, d):
    b = _boxed(spark, d).select(F.col("invoice").alias("doc_id"), "line_no", "variety", "size", "stems", F.col("line_total").alias("line_total"), "provider_id", "article_id", "amount")
    gold = b.groupBy("doc_id", "line_no").agg(F.min_by(F.struct("variety", "size", "stems", "line_total", "article_id"), F.struct("article_id", "provider_id", "amount")).alias("x")).select("doc_id", "line_no", "x.*")
    found = gold.where("line_no < 7").select("doc_id", "line_no", "variety", (F.col("size") + F.when(F.col("line_no") % 3 == 0, 10).otherwise(0)).cast("int").alias("size"), "stems", (F.col("line_total") * F.when(F.col("line_no") % 4 == 0, 1.5).otherwise(1.01)).alias("line_total"), (F.col("article_id") + F.when(F.col("line_no") == 5, 1).otherwise(0)).alias("article_id"))
    return learning.gold_metrics(gold, found, ["variety", "size", "stems", "line_total"])


@query
def event_windows(spark, d):
    return streaming.windows(t.decisions(spark, d))


@query
def sessions(spark, d):
    return streaming.sessions(t.decisions(spark, d))


# --- statistics, lists and learner helpers


@query
def history_stats(spark, d):
    return reports.history_stats(t.lines(spark, d))


@query
def shown_stats(spark, d):
    return reports.shown_stats(_boxed(spark, d))


@query
def synonym_kpis(spark, d):
    return reports.link_kpis(t.link_store(spark, d))


@query
def batch_restats(spark, d):
    before = t.lines(spark, d).groupBy("invoice", F.col("line_no").alias("line")).agg(F.min(F.struct("article_id", "match_status")).alias("x")).select("invoice", "line", "x.*")
    after = before.select("invoice", "line", (F.col("article_id") + F.when(F.col("line") == 3, 1).otherwise(0)).alias("article_id"), F.when((F.col("match_status") == "sin_match") & (F.col("article_id") % 2 == 0), "ok").otherwise(F.col("match_status")).alias("match_status"))
    return reports.restats(before, after)


@query
def last_audit(spark, d):
    return reports.last_entries(t.decisions(spark, d), 20).select("event_id", "ts", "kind")


@query
def batch_states(spark, d):
    return reports.stale(t.decisions(spark, d).where("kind <> 'correct'").select(F.col("key").alias("batch"), "ts", "kind"), LATE)


@query
def spray_roses(spark, d):
    return t.link_lines(spark, d).select("line_id", reports.is_spray_rose(F.col("species"), F.concat(F.col("variety"), F.when(F.col("line_id") % 13 == 0, " spray").otherwise("")), F.col("pack")).alias("spray"))


@query
def list_filters(spark, d):
    rows = t.link_store(spark, d)
    return reports.filtered(rows, "aprendido_confirmado", "ring", ("variety_key", "species")).select("provider_id", "variety_key", "article_id", reports.badge(F.lit("ok")).alias("badge"), reports.origin(F.lit("fuzzy")).alias("origin"))


@query
def species_pool_keys(spark, d):
    c = t.link_catalogue(spark, d)
    return reports.species_pools(c.select("id", F.when(F.col("id") % 11 == 0, F.concat(F.lit("ROSA "), F.col("variety"))).otherwise(F.col("name")).alias("name")))


@query
def known_brands(spark, d):
    return reports.known_brands(t.table(spark, d, "supplier").select(F.col("s_name").alias("name")), ["MYSTIC", "UMA"])


@query
def resolved_links(spark, d):
    a = t.articles(spark, d).select("id", F.concat(F.lit("E"), F.col("id") % 700).alias("durable_id"))
    links = a.select(F.col("id").alias("link_id"), F.col("id").alias("article_id"), F.when(F.col("id") % 5 == 0, "gone").otherwise(F.col("durable_id")).alias("durable_id"))
    return reports.resolved(links, a)


@query
def graded_roses(spark, d):
    c = t.link_catalogue(spark, d).where("species = 'ROSES'")
    grade = F.when(F.col("id") % 2 == 0, "FANCY").otherwise("SELECT")
    names = c.select("id", F.concat_ws(" ", F.lit("ROSA COL"), "variety", F.when(F.col("id") % 3 == 0, grade), F.format_string("%dCM %dU", "size", "pack")).alias("name"))
    return reports.graded_names(c.select(F.col("id").alias("line_id"), "variety", F.lit("FANCY").alias("grade"), "size", "pack"), names)


@query
def variety_forms(spark, d):
    v = t.articles(spark, d).select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("Garden Rose "), F.col("variety"))).otherwise(F.col("variety")).alias("variety"))
    return v.select("id", F.array_join(reports.translations(F.col("variety")), "|").alias("forms"))


@query
def variety_search(spark, d):
    return reports.variety_search(t.requests(spark, d), t.articles(spark, d))


@query
def alternatives(spark, d):
    return reports.alternatives(t.requests(spark, d), t.articles(spark, d))


@query
def header_vocabulary(spark, d):
    lines = t.text_lines(spark, d).where("line_no = 0").select("doc_id", F.posexplode(F.split(F.concat(F.lit("Stems. Unit(cid:12)Price, "), F.col("line")), " ")).alias("position", "cell"))
    return reports.vocabulary(lines)


@query
def similar_layouts(spark, d):
    """Documents against the first one of the same number of fields; a document's first line is its header."""
    prints = learning.fingerprints(t.text_lines(spark, d), r"[0-9]|\|")
    words = t.table(spark, d, "documents").select("doc_id", F.split(F.split("text", "\n")[0], " ").alias("headers"), F.array("lang").alias("keywords"))
    j = prints.join(words, "doc_id").select("doc_id", "n_fields", F.struct("headers", "keywords", "separator", F.lit(0).alias("n_columns"), "n_fields").alias("x"))
    first = j.groupBy("n_fields").agg(F.min_by("x", "doc_id").alias("y"))
    return j.join(first, "n_fields").select("doc_id", F.coalesce(reports.similar("x", "y"), F.lit(False)).alias("similar"))


@query
def positional_rules(spark, d):
    cells = t.text_lines(spark, d).select(F.posexplode(F.split("line", " ")).alias("position", "cell"))
    return reports.positional(cells)


@query
def line_pattern(spark, d):
    return reports.line_pattern(t.text_lines(spark, d), LINE_PATTERNS)


@query
def link_likeness(spark, d):
    lines, c = t.link_lines(spark, d), t.link_catalogue(spark, d)
    j = lines.join(c.select(F.col("id").alias("line_id"), "name", F.col("size").alias("s")), "line_id")
    return j.select("line_id", reports.likeness(F.col("variety"), F.col("name")).alias("score"), reports.suspicious(F.col("variety"), F.col("name"), F.col("size"), F.col("s")).alias("reasons"))


@query
def clean_texts(spark, d):
    return t.table(spark, d, "supplier").select("s_suppkey", reports.clean_header(F.concat(F.lit("(cid:3) "), F.col("s_name"))).alias("header"), reports.clean_name(F.col("s_name")).alias("name"))


# --- records and files


def _lined(spark, d) -> DataFrame:
    part = t.table(spark, d, "part").select(F.col("p_partkey").alias("article_id"), F.concat_ws(" ", F.upper("p_name"), F.repeat(F.upper("p_brand"), 14)).alias("raw"))
    return t.lines(spark, d).join(part, "article_id")


@query
def serialized_lines(spark, d):
    return records.serialise(_lined(spark, d))


@query
def alias_unify(spark, d):
    a = t.articles(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.col("price")).alias("total"), F.when(F.col("id") % 3 == 0, F.col("price") * 2).alias("line_total"), F.col("pack").alias("spb"), F.lit(0.5).alias("confidence"))
    return records.unify(a)


@query
def line_patches(spark, d):
    lines = _lined(spark, d).groupBy("invoice", "line_no").agg(F.min(F.struct("stems", F.lower("match_status").alias("label"))).alias("x")).select("invoice", "line_no", "x.*")
    n = F.col("invoice") + F.col("line_no")
    patches = lines.where(n % 3 == 0).select("invoice", "line_no", F.when(n % 2 == 0, F.col("stems") + 1).alias("stems"), F.when(n % 5 == 0, records.NULL).when(n % 7 == 0, F.repeat(F.lit("ab"), 40)).alias("label"))
    return records.patch(lines, patches, ["stems", "label"], ["invoice", "line_no"])


@query
def restored_lines(spark, d):
    """Lines written as JSON and read again, some without a field or with one of another type."""
    o = t.headers(spark, d)
    value = F.when(F.col("invoice") % 3 == 0, F.to_json(F.struct(F.col("customer_id").alias("stems"), F.col("status").alias("variety")))).when(F.col("invoice") % 3 == 1, F.lit('{"stems": "many", "variety": 5}')).otherwise(F.lit("{broken"))
    return records.restore(o.select("invoice", value.alias("value")), "stems long, variety string", {"stems": 0, "variety": "?"})


@query
def line_confidence(spark, d):
    lines = t.lines(spark, d).select("invoice", "line_no", "article_id", "provider_id", "extraction_confidence", "extraction_source")
    documents = t.headers(spark, d).where("invoice % 10 <> 0").select("invoice", (F.col("invoice") % 7 / 10.0).alias("confidence"), F.when(F.col("invoice") % 2 == 0, "ocr").otherwise("native").alias("source"))
    return records.confident(lines, documents, "invoice")


@query
def preserve_edits(spark, d):
    old = _lined(spark, d).select(F.col("invoice").alias("doc_id"), "raw", F.when(F.col("line_no") % 2 == 0, F.lit("EDITED")).alias("label"), (F.col("line_no") % 3 == 0).alias("deleted"))
    new = _lined(spark, d).where("stems > 10").select(F.col("invoice").alias("doc_id"), F.lower("raw").alias("raw"), "line_total").withColumnRenamed("line_total", "amount")
    return records.keep_edits(old, new)


@query
def durable_lookup(spark, d):
    a = t.articles(spark, d).select("id", F.concat(F.lit("C"), F.col("id") % 500).alias("code"), "reference")
    wanted = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("want_id"), F.concat(F.lit("C"), F.col("o_orderkey") % 700).alias("code"), F.format_string("f%06d", F.col("o_orderkey") % 3000).alias("reference"))
    return records.by_durable_key(wanted, a)


@query
def id_migration(spark, d):
    a = t.articles(spark, d)
    links = a.select(F.col("id").alias("link_id"), F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.expr("substring(name, 1, length(name) - 1)")).alias("name"))
    return records.migrate_ids(links, a)


@query
def orphan_merge(spark, d):
    l = t.lines(spark, d)
    links = _tokens(spark, d).join(l.select("provider_id", "article_id", "match_status", "stems"), ["provider_id", "article_id"]).select(F.when(F.col("stems") % 4 == 0, 0).otherwise(F.col("provider_id")).alias("provider_id"), F.col("token").alias("variety"), "article_id", F.col("match_status").alias("status"), F.col("stems").cast("long").alias("uses"))
    owners = l.groupBy("article_id").agg(F.min("provider_id").alias("owner"))
    return records.merge_orphans(links, owners, ["ok", "ambiguous_match", "sin_match"])


@query
def key_rewrite(spark, d):
    return records.rewrite_packs(t.articles(spark, d).select("variety", "size", "pack", F.col("id").alias("article_id")), 5, 25)


@query
def truncated_names(spark, d):
    c = F.col
    stored = F.when(c("id") % 4 == 0, F.substring("name", 1, 9)).otherwise(c("name"))
    return t.articles(spark, d).select("id", records.rebuild_name(stored, c("variety"), c("size"), c("pack"), F.when(c("id") % 3 == 0, "").otherwise(c("brand"))).alias("name"))


@query
def provider_suffix(spark, d):
    return t.articles(spark, d).select("id", records.strip_suffix(F.col("variety"), ["rod", "bolt", "ring"]).alias("stripped"))


@query
def similarity_buckets(spark, d):
    """How many links of lines to their articles have which likeness."""
    return link_likeness(spark, d).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query
def color_modifiers(spark, d):
    a = t.articles(spark, d)
    name = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("DARK", "LIGHT", "NEON", ""))), (F.col("id") % 4 + 1).cast("int")), "variety", F.when(F.col("id") % 5 == 0, "CLARO"))
    variety = F.when(F.col("id") % 3 == 0, F.concat(F.col("variety"), F.lit(" CLARO"))).otherwise(F.col("variety"))
    return a.select("id", F.array_join(records.modifiers(variety, name), ",").alias("missing"))


@query
def match_confidence(spark, d):
    return t.lines(spark, d).select("invoice", "line_no", "article_id", "provider_id", records.confidence(F.col("link_confidence"), F.lit(0.0), F.col("extraction_confidence")).alias("confidence"))


@query
def sql_export(spark, d):
    return records.export_sql(t.articles(spark, d).select(F.col("id").alias("link_id"), (F.col("id") % 9).alias("provider_id"), F.replace("variety", F.lit(" "), F.lit("' ")).alias("variety"), F.col("size").cast("long").alias("size"), F.when(F.col("id") % 6 == 0, F.lit(None).cast("long")).otherwise(F.col("id")).alias("article_id")))


OWNERS = [("alpha", ["thnt", "nding", "er"]), ("beta", ["schen", "ein"]), ("gamma", ["token", "="]), ("delta", ["mente"])]


@query
def keyword_providers(spark, d):
    return records.keyword_owner(t.table(spark, d, "documents").select("doc_id", "text"), OWNERS)


@query
def keyword_majority(spark, d):
    words = t.table(spark, d, "documents").select(F.concat_ws("-", "lang", "source").alias("group_id"), "doc_id", F.explode(F.split("text", " ")).alias("word")).where("word rlike '^[a-z]+$'")
    return records.majority_words(words)


@query
def species_share(spark, d):
    texts = t.table(spark, d, "documents").select(F.col("source").alias("group_id"), "text")
    return records.dominant(texts, {"en": "th", "de": "sch", "fr": "eau", "es": "ción"})


@query
def top_corrections(spark, d):
    return records.top_corrections(t.decisions(spark, d), 25)


@query
def penalty_ranking(spark, d):
    return records.ranking(invoices.line_findings(t.lines(spark, d)).select(F.concat("code", F.lit(" (line "), F.col("line_no").cast("string"), F.lit(")")).alias("code")))


@query
def free_text_filter(spark, d):
    return records.free_text(t.articles(spark, d).select("id", "name", "family", "reference"), ["name", "family", "reference"], "Ring 1")


@query
def folder_triage(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", F.col("source").alias("folder"), "text")
    return records.triage(docs, records.keyword_owner(docs.select("doc_id", "text"), OWNERS).withColumnRenamed("owner", "provider"))


@query
def file_denylist(spark, d):
    name = F.element_at(F.split("url", "/"), -1)
    return t.table(spark, d, "pages").select("page_id", name.alias("name"), files.skipped(name, ["A", "P", "T", "E"]).alias("skipped"))


@query
def word_rows(spark, d):
    words = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 3.0).alias("top"), F.col("l_extendedprice").alias("x0"), F.col("l_partkey").cast("string").alias("text"))
    return files.word_rows(words, 2.0)


@query
def sql_dump(spark, d):
    """Catalogue rows written as a dump and read again."""
    p = t.table(spark, d, "part")
    row = F.format_string("(%d, '%s', 'it\\'s, %s', NULL, %d, '', '', '', '', %d),", "p_partkey", "p_name", "p_brand", "p_size", "p_partkey")
    lines = p.select(row.alias("value")).union(p.select(F.concat(F.lit("-- "), "p_name").alias("value"))).union(p.select(F.lit("(1, 'short')").alias("value")))
    return files.dump_rows(lines, "id long, name string, brand string, nothing string, size int, e1 string, e2 string, e3 string, e4 string, again long").select("id", "name", "brand", "nothing", "size", "again")


@query
def retention(spark, d):
    return files.expired(t.decisions(spark, d), 20).select("event_id", "key", "kind")

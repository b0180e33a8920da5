"""Statistics, lists and checks around the linker and the learner; small functions of columns that they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COLORS, canonical, fold
from . import linking

# Where a link came from, badges of states, prefixes of species in names, columns that a header word stands for, weights of alternatives.
ORIGINS = {"synonym": "manual", "priority": "auto", "branded": "auto-marca", "exact": "auto", "delegation": "auto", "color_strip": "auto-color", "color_prefix": "auto-color", "color_suffix": "auto-color", "connector_strip": "auto", "bicolor_ext": "auto", "rose": "auto", "fuzzy": "auto-fuzzy"}
BADGES = {"ok": "green", "ambiguous_match": "amber", "sin_match": "red", "mixed_box": "blue"}
POOLS = {"ROSA EC ": ["ROSES_EC"], "ROSA COL ": ["ROSES_COL"], "ROSA ": ["ROSES_EC", "ROSES_COL"], "CLAVEL ": ["CARNATIONS"], "MINI CLAVEL ": ["CARNATIONS"], "HYDRANGEA ": ["HYDRANGEAS"], "ALSTROMERIA ": ["ALSTROEMERIA"], "PANICULATA ": ["GYPSOPHILA"], "CRISANTEMO ": ["CHRYSANTHEMUM"]}
HEADER_WORDS = {"VARIETY": "variety", "DESCRIPTION": "variety", "PRODUCT": "variety", "LENGTH": "size", "SIZE": "size", "GRADE": "grade", "BUNCH": "bunches", "STEMS": "stems", "QTY": "stems", "PRICE": "price", "UNIT": "price", "TOTAL": "total", "AMOUNT": "total", "BOX": "box_type", "LABEL": "label"}
SPECIES_DEFAULTS = {"ROSES": (50, 25), "CARNATIONS": (70, 20), "HYDRANGEAS": (60, 1), "ALSTROEMERIA": (70, 10), "GYPSOPHILA": (80, 25), "CHRYSANTHEMUM": (70, 10)}


def _map(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def history_stats(lines: DataFrame) -> DataFrame:
    """Invoices, lines that are linked and that aren't, their money, and the share of linked ones when each (provider, article) counts once, by its last line."""
    last = lines.groupBy("provider_id", "article_id").agg(F.max_by("match_status", F.struct("invoice", "line_no")).alias("s")).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("s") == "ok").alias("ok_keys"))
    every = lines.agg(F.countDistinct("invoice").alias("invoices"), F.count_if(F.col("match_status") == "ok").alias("ok"), F.count_if(F.col("match_status") != "ok").alias("failed"), F.sum("amount").cast("double").alias("total"))
    both = every.unionByName(last, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("key_rate", F.round(F.col("ok_keys") / F.col("n_keys"), 4))


def shown_stats(lines: DataFrame) -> DataFrame:
    """What a page shows of an invoice; children of mixed boxes don't count."""
    own = lines.where("box_type <> 'MIX'")
    s = F.col("match_status")
    return own.groupBy("invoice").agg(F.count_if(s == "ok").alias("ok"), F.count_if(s == "sin_match").alias("unmatched"), F.count_if(s == "ambiguous_match").alias("review"), F.sum("stems").alias("stems"), F.sum("amount").cast("double").alias("total"))


def link_kpis(links: DataFrame) -> DataFrame:
    return links.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("provider_id").alias("providers"), F.countDistinct("article_id").alias("articles"))


def restats(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed for each batch when its lines were linked again: invoice, ok before and after, lines whose state or article changed. Both: invoice, line, article_id, match_status."""
    j = before.join(after.select("invoice", "line", F.col("article_id").alias("new_id"), F.col("match_status").alias("new_status")), ["invoice", "line"], "left")
    changed = ~F.col("article_id").eqNullSafe(F.col("new_id")) | ~F.col("match_status").eqNullSafe(F.col("new_status"))
    return j.groupBy("invoice").agg(F.count_if(F.col("match_status") == "ok").alias("ok_before"), F.count_if(F.col("new_status") == "ok").alias("ok_after"), F.count_if(changed).alias("changed"))


def last_entries(log: DataFrame, n: int) -> DataFrame:
    """The last n entries, oldest first."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).orderBy("ts", "event_id")


def stale(batches: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """State of each batch from its events (batch, ts, kind 'proposal' for progress): done when a 'confirm' came, stale after ``minutes`` without any, else running."""
    b = batches.groupBy("batch").agg(F.max("ts").alias("last"), F.count_if(F.col("kind") == "confirm").alias("done"))
    late = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))
    return b.select("batch", F.when(F.col("done") > 0, "done").when(F.col("last") < late, "stale").otherwise("running").alias("state"))


def is_spray_rose(species: Column, variety: Column, pack: Column) -> Column:
    return (species == "ROSES") & ((pack == 10) | F.upper(variety).rlike(r"\b(?:SP|SPRAY)\b"))


def filtered(rows: DataFrame, status: str | None = None, text: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a state whose columns hold a text, in either case."""
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows if not text else rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def species_pools(names: DataFrame) -> DataFrame:
    """id, pool, rest: the pools that an article's name is looked for in, by the first prefix that fits, and what is left of the name. A bare rose is in both pools."""
    n = F.upper("name")
    cases = F.coalesce(*[F.when(n.startswith(p), F.struct(F.array(*map(F.lit, pools)).alias("pools"), F.substr(n, F.lit(len(p) + 1)).alias("rest"))) for p, pools in POOLS.items()], F.struct(F.array(F.lit("OTHER")).alias("pools"), n.alias("rest")))
    return names.select("id", cases.alias("x")).select("id", F.explode("x.pools").alias("pool"), "x.rest")


def known_brands(providers: DataFrame, more: list[str], least: int = 4) -> DataFrame:
    """Words that may be brands: providers' names, their words of at least ``least`` letters, and some by hand. ``providers``: name."""
    spark = providers.sparkSession
    words = providers.select(F.explode(F.concat(F.array(F.upper("name")), F.filter(F.split(F.upper("name"), "[^A-Z0-9]+"), lambda w: F.length(w) >= least))).alias("brand"))
    return words.union(spark.createDataFrame([(b,) for b in more], "brand string")).distinct()


def resolved(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Links with the current article: the one that has the link's durable id now, else the stored one. links: link_id, article_id, durable_id; articles: id, durable_id."""
    now = articles.groupBy("durable_id").agg(F.min("id").alias("new_id"))
    return links.join(now, "durable_id", "left").select("link_id", F.coalesce("new_id", "article_id").alias("article_id"), (F.col("new_id").isNotNull() & (F.col("new_id") != F.col("article_id"))).alias("moved"))


def graded_names(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """Roses by name with their grade, else without: line_id, article_id, with_grade."""
    name = lambda *x: F.concat_ws(" ", *x)
    tail = F.format_string("%dCM %dU", "size", "pack")
    keys = lines.select("line_id", F.posexplode(F.array(name(F.lit("ROSA COL"), "variety", "grade", tail), name(F.lit("ROSA COL"), "variety", tail))).alias("n", "name"))
    by_name = articles.groupBy("name").agg(F.min("id").alias("id"))
    best = keys.join(by_name, "name").groupBy("line_id").agg(F.min(F.struct("n", "id")).alias("x"))
    return best.select("line_id", F.col("x.id").alias("article_id"), (F.col("x.n") == 0).alias("with_grade"))


# Phrases of varieties and what the catalogue calls them; prefixes that may be missing there.
TRANSLATIONS = {
    "GYPSOPHILA OVER TIME WHITE": "OVERTIME BLANCO", "GYPSOPHILA OVER TIME": "OVERTIME", "OVER TIME WHITE": "OVERTIME BLANCO", "OVER TIME": "OVERTIME",
    "GYPSOPHILA XLENCE NATURAL": "XLENCE BLANCO", "GYPSOPHILA XLENCE RAINBOW MIX LIGHT": "XLENCE TENIDA RAINBOW", "GYPSOPHILA XLENCE": "XLENCE BLANCO",
    "GYPSOPHILA": "PANICULATA", "GARDEN ROSE": "LA GARDEN", "TINTED BLUE": "TENIDA AZUL", "TINTED RED": "TENIDA ROJO", "TINTED PINK": "TENIDA ROSA",
    "TINTED GREEN": "TENIDA VERDE", "TINTED ORANGE": "TENIDA NARANJA", "TINTED PURPLE": "TENIDA MORADO", "TINTED BLACK": "TENIDA NEGRO", "TINTED": "TENIDA",
    "WHITE": "BLANCO", "RED": "ROJO", "YELLOW": "AMARILLO", "PINK": "ROSA", "BLUE": "AZUL", "ORANGE": "NARANJA", "GREEN": "VERDE", "PURPLE": "MORADO",
    "LIGHT": "CLARO", "DARK": "OSCURO", "NATURAL": "BLANCO", "JESSIKA": "JESSICA", "TOFFE": "TOFFEE",
    "OHARA PINK": "OHARA ROSA", "OHARA WHITE": "OHARA BLANCO", "OHARA RED": "OHARA ROJO", "O'HARA PINK": "OHARA ROSA", "O'HARA WHITE": "OHARA BLANCO",
    "PINK O'HARA": "OHARA ROSA", "WHITE O'HARA": "OHARA BLANCO", "PINK OHARA": "OHARA ROSA", "WHITE OHARA": "OHARA BLANCO", "LIMONADA": "LEMONADE",
}
PREFIXES = ("GYPSOPHILA ", "GARDEN ROSE ", "PANICULATA ")
ADDED_PREFIX = "GYPSOPHILA "


def translations(variety: Column, table: dict[str, str] = TRANSLATIONS) -> Column:
    """Forms under which a variety may stand, in order and each once.

    Itself; without a species prefix; each of these with one phrase translated, the longest phrase first; each of these word by word; then all of
    them without the added prefix, and with it.
    """
    v = fold(variety)
    bare = v
    for prefix in reversed(PREFIXES):
        bare = F.when(v.startswith(prefix), F.substring(v, len(prefix) + 1, 10_000)).otherwise(bare)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(table.items(), key=lambda x: -len(x[0]))])
    bases = F.array_distinct(F.array(v, bare))
    phrases = F.flatten(F.transform(bases, lambda x: F.transform(F.filter(pairs, lambda p: F.contains(x, p["a"])), lambda p: F.replace(x, p["a"], p["b"]))))
    worded = F.transform(bases, lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.coalesce(_map(table, w), w)), " "))
    first = F.array_distinct(F.filter(F.concat(bases, phrases, worded), lambda x: x != ""))
    bared = lambda x: F.when(x.startswith(ADDED_PREFIX), F.substring(x, len(ADDED_PREFIX) + 1, 10_000))
    more = F.flatten(F.transform(first, lambda x: F.filter(F.array(bared(x), F.concat(F.lit(ADDED_PREFIX), x)), lambda y: y.isNotNull())))
    return F.array_distinct(F.concat(first, more))


def variety_search(lines: DataFrame, articles: DataFrame, limit: int = 5) -> DataFrame:
    """Articles of any form of a line's variety, those of its size first, each once: line_id, place, article_id. The catalogue's ids are cut to the first of each variety and size before the join."""
    a = articles.groupBy(fold(F.col("variety")).alias("form"), F.col("size").alias("s")).agg(F.min("id").alias("id"))
    forms = lines.select("line_id", "size", F.posexplode(translations(F.col("variety"))).alias("n", "form"))
    j = forms.join(a, "form").groupBy("line_id", "id").agg(F.min(F.struct((F.col("s") != F.col("size")).cast("int").alias("off"), "n")).alias("x"))
    return j.withColumn("place", F.row_number().over(Window.partitionBy("line_id").orderBy("x", "id"))).where(F.col("place") <= limit).select("line_id", "place", F.col("id").alias("article_id"))


def alternatives(lines: DataFrame, articles: DataFrame, limit: int = 5, least: int = 5) -> DataFrame:
    """Other articles for a line: variety equal 10 or held 3, size 5, pack 3, own brand 2; of the same first word."""
    word = lambda c: F.split(c, " ")[0]
    a = articles.where("variety is not null").select("id", F.col("variety").alias("av"), "size", "pack", "brand")
    asked = lines.select("variety").distinct().withColumn("w", word("variety"))
    held = F.contains(F.col("av"), F.col("variety")) | F.contains(F.col("variety"), F.col("av"))
    base = F.when(F.col("av") == F.col("variety"), 10).when(held, 3).otherwise(0)
    base = asked.join(linking.dealt(a.select("av").distinct().withColumn("w", word("av"))), "w").select("variety", "av", base.alias("base"))
    graded = base.join(linking.dealt(a), "av").select("variety", "base", "id", "size", "pack", "brand")
    return linking.best_equal(lines, graded, {"size": 5, "pack": 3, "brand": 2}, limit, least)


def origin(source: Column) -> Column:
    return F.coalesce(_map(ORIGINS, source), F.lit("auto"))


def badge(status: Column) -> Column:
    return F.coalesce(_map(BADGES, status), F.lit("grey"))


def clean_header(text: Column) -> Column:
    """A table's header cell: upper case, letters and digits only, spaces squeezed; (cid:12) marks go."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.regexp_replace(text, r"\(cid:[0-9]+\)", "")), "[^A-Z0-9 ]+", " "), " +", " "))


def clean_name(text: Column) -> Column:
    """A name that files and tables can bear."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def vocabulary(cells: DataFrame) -> DataFrame:
    """What header cells stand for: the first word of the vocabulary that a cell holds or that holds the cell. cells: doc_id, position, cell."""
    h = clean_header(F.col("cell"))
    fits = F.filter(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(f).alias("field")) for w, f in HEADER_WORDS.items()]), lambda x: F.contains(h, x["word"]) | ((F.length(h) >= 3) & F.contains(x["word"], h)))
    return cells.select("doc_id", "position", F.get(fits, F.lit(0))["field"].alias("field")).where("field is not null")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def similar(x: str, y: str) -> Column:
    """Whether two layouts are alike; checks that either side can't answer are passed. Columns of structs x and y: headers, keywords, separator, n_columns, n_fields."""
    c = lambda s, f: F.col(f"{s}.{f}")
    empty = lambda f: (F.size(c(x, f)) == 0) | (F.size(c(y, f)) == 0)
    return (
        (empty("headers") | (jaccard(c(x, "headers"), c(y, "headers")) >= 0.6)) & ((c(x, "n_columns") == 0) | (c(y, "n_columns") == 0) | (c(x, "n_columns") == c(y, "n_columns"))) & (empty("keywords") | F.arrays_overlap(c(x, "keywords"), c(y, "keywords")))
        & ((c(x, "separator") == "") | (c(y, "separator") == "") | (c(x, "separator") == c(y, "separator"))) & ((c(x, "n_fields") == 0) | (c(y, "n_fields") == 0) | (F.abs(c(x, "n_fields") - c(y, "n_fields")) <= 2))
    )


def positional(cells: DataFrame) -> DataFrame:
    """Fields by place, of texts without a header: the kind that most cells of a place have; of text places the one with the longest words is the variety.

    cells: position, cell.
    """
    v = F.col("cell")
    kind = F.when(v.rlike(r"^\$?[0-9]+[.,][0-9]+$"), "price").when(v.rlike("^[0-9]+$"), "count").when(v.rlike("[A-Za-z]"), "text").otherwise("other")
    n = cells.groupBy("position", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("cell")).alias("letters"))
    most = n.groupBy("position").agg(F.max(F.struct("n", "kind", "letters")).alias("x"), F.sum("n").alias("cells")).select("position", "x.kind", F.col("x.n").alias("n"), "cells", (F.col("x.letters") / F.col("x.n")).alias("length"))
    longest = F.row_number().over(Window.orderBy((F.col("kind") == "text").desc(), F.desc("length"), "position"))  # a row a place
    return most.withColumn("first", longest).select("position", F.when((F.col("kind") == "text") & (F.col("first") == 1), "variety").otherwise(F.col("kind")).alias("field"), F.round(F.col("n") / F.col("cells"), 4).alias("share"))


def line_pattern(lines: DataFrame, patterns: list[str], least: float = 0.3) -> DataFrame:
    """The pattern that most lines match, if at least ``least`` of them do: pattern_no, hits, share. lines: line."""
    hits = lines.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("line").rlike(p)).alias(f"p{i}") for i, p in enumerate(patterns)])
    rows = hits.select("n", F.explode(F.array(*[F.struct(F.col(f"p{i}").alias("hits"), F.lit(-i).alias("minus")) for i in range(len(patterns))])).alias("x"))
    best = rows.agg(F.max("x").alias("x"), F.max("n").alias("n"))
    return best.select((-F.col("x.minus")).alias("pattern_no"), "x.hits", F.round(F.col("x.hits") / F.col("n"), 4).alias("share")).where(F.col("share") >= least)


def likeness(variety: Column, name: Column, table: dict[str, str] = COLORS) -> Column:
    """0 to 100, how well a variety fits an article's name: held by it 100; overlapping with its variety 85, translated 95; equal letters by place from 75 % on; shared words up to 85."""
    v, a = canonical(variety), canonical(name)
    av = F.trim(F.regexp_replace(F.regexp_replace(a, r"^(?:ROSA (?:EC|COL)|ROSA|CLAVEL COL|CLAVEL|HYDRANGEA|PANICULATA|ALSTROMERIA) ", ""), r" [0-9]+CM.*$", ""))
    vt = F.array_join(F.transform(F.split(v, " "), lambda w: F.coalesce(_map(table, w), w)), " ")
    n = F.greatest(F.length(v), F.length(av))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(v), F.length(av)), F.lit(1))), F.lit(0), lambda s, i: s + (F.substr(v, i, F.lit(1)) == F.substr(av, i, F.lit(1))).cast("int"))
    vw, aw = F.array_union(F.split(v, " "), F.split(vt, " ")), F.array_union(F.split(av, " "), F.split(a, " "))
    overlap = F.size(F.array_intersect(vw, aw)) / F.least(F.size(F.array_distinct(F.split(v, " "))), F.size(F.array_distinct(F.split(av, " "))))
    return (
        F.when(F.contains(a, v) | (v == av), 100).when(F.contains(av, v) | F.contains(v, av), 85).when(F.contains(a, vt) | (vt == av), 95).when(F.contains(av, vt) | F.contains(vt, av), 85)
        .when((F.abs(F.length(v) - F.length(av)) <= 2) & (100 * same >= 75 * n), F.floor(100 * same / n)).otherwise(F.least(F.floor(overlap * 85), F.lit(85))).cast("int")
    )


def suspicious(variety: Column, name: Column, size: Column, article_size: Column) -> Column:
    """Why a link should be looked at, joined by commas."""
    score = likeness(variety, name)
    codes = F.array(F.when(score < 50, F.lit("unlike")), F.when((size > 0) & (article_size > 0) & (size != article_size), F.lit("size")), F.when(F.trim(variety) == "", F.lit("empty")))
    return F.array_join(F.filter(codes, lambda x: x.isNotNull()), ",")

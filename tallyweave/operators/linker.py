"""The whole linker: every source of candidates, vetoes, the running score, boost and pin, and one decision a line.

``lines``: line_id, provider_id, species, origin, variety, size, pack, grade, spray (boolean). ``catalogue``: id, name, variety, species,
origin, size, pack, brand (empty if generic). ``links``: provider_id, species, variety_key, size, pack, grade, article_id, status, trust. ``brands``:
provider_id, brand (a provider's own). ``hard``: brands that only their owners' lines may have. ``usage``: provider_id, article_id, n.
``fuzzy_hits``: line_id, article_id, percent.

All joins are by equality on keys of the catalogue's aggregates; a line has a few dozen candidates, so windows by line are small. Scores are
whole ten-thousandths: sums are exact, whatever their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical, expected_name
from .linking import dealt, same_rows
from .records import MODIFIERS as COLOR_MODIFIERS

# Order of candidate sources (the smaller one keeps a pair), thresholds in thousandths, and the words that strips look for.
# (Sources of one rank in the order in which they are asked.)
PRIORITY = {"synonym": 0, "priority": 10, "branded": 20, "exact": 30, "delegation": 40, "color_prefix": 41, "color_suffix": 42, "connector_strip": 43, "bicolor_ext": 44, "rose": 50, "fuzzy": 60, "spray_mixto": 70}
PRIOR = {"synonym": 1000, "branded": 1000, "exact": 800, "rose": 800, "color_prefix": 400, "fuzzy": 0, "spray_mixto": 0}
OTHER_PRIOR = 500
OK, DOUBTFUL = 700, 500
COLORS_BEFORE = r"^(?:HOT PINK|LIGHT PINK|PINK|RED|ORANGE|YELLOW|WHITE|PEACH|CREAM|SALMON) "
COLORS_AFTER = r" (?:(?:IN|EN) )?(?:HOT PINK|LIGHT PINK|PINK|RED|ORANGE|YELLOW|WHITE|PEACH|CREAM|SALMON|BLANCO|NARANJA|AMARILLO|ROJO|ROSA)$"
CONNECTORS = r" (?:AND|Y) "
GENERIC = "ROSE ROSES CARNATION CARNATIONS GYPSOPHILA CHRYSANTHEMUM HYDRANGEA ALSTROEMERIA ALSTRO ALSTROMERIA ROSA ROSAS CLAVEL CLAVELES PANICULATA CRISANTEMO HORTENSIA HORTENSIAS MINI SPRAY GARDEN STANDARD EXTRA COLORS ASSORTED MIX MIXED".split()
DELEGATING_PROVIDER = 4471


def strips(lines: DataFrame) -> DataFrame:
    """Spellings under which a line's variety may stand in the catalogue: line_id, source, ord, variety.

    The variety itself; without up to three leading words (one provider's delegations); of roses without a colour before or behind it,
    without connectors, and each of the simpler forms with BICOLOR behind it.
    """
    v = canonical(F.col("variety"))
    behind = F.regexp_replace(v, COLORS_AFTER, "")
    plain = lambda x: F.regexp_replace(x, CONNECTORS, " ")
    words = F.split(v, " ")
    rose = F.col("species") == "ROSES"
    one = lambda source, form, cond, ord=0: F.when(cond & (form != "") & F.when(F.lit(source == "priority"), True).otherwise(form != v), F.struct(F.lit(source).alias("source"), F.lit(ord).alias("ord"), form.alias("variety")))
    forms = [
        one("priority", v, F.lit(True)),
        *[one("delegation", F.array_join(F.slice(words, n + 1, F.greatest(F.size(words), F.lit(1))), " "), (F.col("provider_id") == DELEGATING_PROVIDER) & (F.size(words) > n), n) for n in (1, 2, 3)],
        one("color_prefix", F.regexp_replace(v, COLORS_BEFORE, ""), rose, 1), one("color_suffix", behind, rose, 1),
        one("connector_strip", plain(v), rose, 1), one("connector_strip", plain(behind), rose & (plain(behind) != behind), 2),
        *[one("bicolor_ext", F.concat(f, F.lit(" BICOLOR")), rose, i) for i, f in enumerate((v, behind, plain(v), plain(behind)))],
    ]
    return lines.select("line_id", "provider_id", "size", F.explode(F.filter(F.array(*forms), lambda x: x.isNotNull())).alias("x")).select("line_id", "provider_id", "size", "x.*").distinct()


def rungs(keys: DataFrame, catalogue: DataFrame, brands: DataFrame, by: list[str]) -> DataFrame:
    """The article of each key (columns ``by``, provider_id, variety, size) by seven rungs.

    Of the size: 1 own brand, 2 the provider's own article, 3 generic; then 4 own brand of the nearest size, 5 the provider's first article, 6 generic of the
    nearest size, 7 any of the nearest size. A line without a size begins at 4. Another's brand of equal size is the last rung like any other, so it loses to
    the own brand's nearest size. The catalogue is summed first, to the least id of each variety, size and brand, and of each variety, provider and size: a
    key meets two short lists of sizes, not articles. Without a column provider_id in the catalogue there are no rungs 2 and 5.
    """
    a = catalogue.withColumn("variety", canonical(F.col("variety")))
    listed = a.groupBy("variety", "brand", F.col("size").alias("s")).agg(F.min("id").alias("id")).groupBy("variety").agg(F.collect_list(F.struct("s", "brand", "id")).alias("there"))
    own = brands.groupBy("provider_id").agg(F.collect_set("brand").alias("own"))
    key = ["provider_id", "variety", "size"]
    j = keys.select(key).distinct().join(own, "provider_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    exact = lambda x: (F.col("size") > 0) & (x["s"] == F.col("size"))
    gap = lambda x: F.abs(x["s"] - F.col("size"))
    step = lambda rung, gap, id: F.struct(rung.alias("rung"), gap.alias("gap"), id.alias("id"))
    one = lambda x: F.when(F.array_contains("own", x["brand"]), F.when(exact(x), 1).otherwise(4)).when(x["brand"] == "", F.when(exact(x), 3).otherwise(6)).otherwise(7)
    found = F.transform("there", lambda x: step(one(x), gap(x), x["id"]))
    if "provider_id" in catalogue.columns:
        mine = a.groupBy("variety", "provider_id", F.col("size").alias("s")).agg(F.min("id").alias("id")).groupBy("variety", "provider_id").agg(F.collect_list(F.struct("s", "id")).alias("mine"))
        j = j.join(dealt(mine), ["variety", "provider_id"], "left")
        of_provider = F.transform("mine", lambda x: step(F.when(exact(x), 2).otherwise(5), F.lit(0), x["id"]))
        found = F.concat(found, F.coalesce(of_provider, F.array()))
    # the longest lists come last, so that none of them is dealt with a key
    best = j.join(dealt(listed), "variety").select(*key, F.array_min(found).alias("x"))
    return same_rows(keys, best, key).select(*by, F.col("x.id").alias("article_id"))


def gather(lines: DataFrame, catalogue: DataFrame, links: DataFrame, brands: DataFrame, fuzzy_hits: DataFrame | None = None) -> DataFrame:
    """line_id, article_id, source, percent, status, trust: all sources' finds, each pair once, by its first source."""
    nothing = [F.lit(None).cast("int").alias("percent"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("trust")]
    key = [F.col("provider_id"), F.col("species"), canonical(F.col("variety")).alias("variety_key"), F.col("size"), F.col("pack"), F.upper("grade").alias("grade")]
    names = ["provider_id", "species", "variety_key", "size", "pack", "grade"]
    learned = lines.select("line_id", *key).join(dealt(links.where("status <> 'rechazado'")), names).select("line_id", "article_id", F.lit("synonym").alias("source"), nothing[0], "status", "trust")
    found = rungs(strips(lines), catalogue, brands, ["line_id", "source", "ord"])
    # of a provider's delegations the shortest that leaves a known variety
    first = F.row_number().over(Window.partitionBy("line_id", "source").orderBy("ord"))
    found = found.withColumn("n", first).where("source <> 'delegation' or n = 1").select("line_id", "article_id", "source", *nothing)
    named = lines.select("line_id", "provider_id", expected_name(F.col("species"), F.col("variety"), F.col("size"), F.col("pack"), F.col("grade"), F.col("origin")).alias("name"))
    by_name = catalogue.groupBy("name").agg(F.min("id").alias("article_id"))
    # the expected name, else the one without its origin
    spelled = named.select("line_id", F.posexplode(F.array("name", F.regexp_replace("name", "^(ROSA|ALSTROMERIA) (?:EC|COL) ", "$1 "))).alias("n", "name"))
    exact = spelled.join(dealt(by_name), "name").groupBy("line_id").agg(F.min_by("article_id", "n").alias("article_id")).select("line_id", "article_id", F.lit("exact").alias("source"), *nothing)
    branded = named.join(brands, "provider_id").withColumn("name", F.concat_ws(" ", "name", "brand")).join(dealt(by_name), "name").select("line_id", "article_id", F.lit("branded").alias("source"), *nothing)
    # roses of the same size, pack and origin whose variety begins with the line's, else holds it: the first word blocks the former, its equality the latter.
    # Many lines and articles say the same, so distinct ones meet.
    said = ["v", "size", "pack", "origin"]
    roses = lines.where("species = 'ROSES' and size > 0 and pack > 0").select("line_id", canonical(F.col("variety")).alias("v"), "size", "pack", "origin")
    r = roses.select(said).distinct()
    c = catalogue.where("species = 'ROSES'").groupBy(canonical(F.col("variety")).alias("av"), "size", "pack", "origin").agg(F.min("id").alias("id"))
    block = ["size", "pack", "origin", "w"]
    begins = r.withColumn("w", F.split("v", " ")[0]).join(dealt(c.withColumn("w", F.split("av", " ")[0])), block).where(F.col("av").startswith(F.col("v"))).groupBy(said).agg(F.min("id").alias("article_id"))
    others = r.join(dealt(begins), said, "left_anti").withColumn("w", F.split("v", " ")[0])
    holds = others.join(dealt(c.withColumn("w", F.explode(F.array_distinct(F.split("av", " "))))), block).where(F.contains(F.col("av"), F.col("v"))).groupBy(said).agg(F.min("id").alias("article_id"))
    rose = roses.join(dealt(begins.union(holds)), said).select("line_id", "article_id", F.lit("rose").alias("source"), *nothing)
    every = learned.union(found).union(exact).union(branded).union(rose)
    if fuzzy_hits is not None:
        every = every.union(fuzzy_hits.select("line_id", "article_id", F.lit("fuzzy").alias("source"), F.col("percent").cast("int"), *nothing[1:]))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("source"))
    best = F.min(F.struct(rank.alias("rank"), "source", F.coalesce(-F.col("percent"), F.lit(0)).alias("minus"), "status", "trust"))
    return every.groupBy("line_id", "article_id").agg(best.alias("x")).select("line_id", "article_id", "x.source", F.nullif(-F.col("x.minus"), F.lit(0)).alias("percent"), "x.status", "x.trust")


def beside(found: DataFrame, lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Candidates with what the line says and what the article says (prefix a_)."""
    a = catalogue.select(F.col("id").alias("article_id"), *[F.col(c).alias(f"a_{c}") for c in ("name", "variety", "species", "origin", "size", "pack", "brand")])
    return found.join(dealt(a), "article_id").join(dealt(lines), "line_id")


def vetoes() -> Column:
    """What rules a candidate out: another species, another origin (roses and carnations), a size more than 20 off, and of spray roses any pack but 10."""
    c = F.col
    codes = F.array(
        F.when((c("species") != c("a_species")) & (c("species") != "OTHER") & (c("a_species") != "OTHER"), F.lit("species")),
        F.when(c("species").isin("ROSES", "CARNATIONS") & (c("origin") != "") & (c("a_origin") != "") & (c("origin") != c("a_origin")), F.lit("origin")),
        F.when((c("size") > 0) & (c("a_size") > 0) & (F.abs(c("size") - c("a_size")) > 20), F.lit("size")),
        F.when(c("spray") & (c("a_pack") != 10), F.lit("spray pack")),
    )
    return F.filter(codes, lambda x: x.isNotNull())


def viable(pairs: DataFrame) -> DataFrame:
    """Candidates without a veto; a link that a person confirmed passes all vetoes."""
    bypass = F.coalesce((F.col("source") == "synonym") & (F.col("status") == "manual_confirmado"), F.lit(False))
    return pairs.withColumn("vetoes", vetoes()).where((F.size("vetoes") == 0) | bypass)


def evidence(pairs: DataFrame, brands: DataFrame, hard: list[str], usage: DataFrame) -> DataFrame:
    """The pairs with what speaks for and against them, and ``points`` (ten-thousandths). Order matters: the soft brand rule reads the sum so far."""
    c = F.col
    own = brands.groupBy("provider_id").agg(F.collect_set("brand").alias("own"))
    d = pairs.join(own, "provider_id", "left").join(dealt(usage.select("provider_id", "article_id", F.col("n").alias("used"))), ["provider_id", "article_id"], "left")
    v = canonical(c("variety"))
    tokens = F.filter(F.split(v, " "), lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC))
    gap = F.abs(c("size") - c("a_size"))
    d = d.withColumns({
        "any_token": F.exists(tokens, lambda t: F.contains(c("a_name"), t)), "every_token": (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(c("a_name"), t)),
        "extra_color": F.size(F.array_except(F.array_intersect(F.split("a_name", " "), F.array(*map(F.lit, COLOR_MODIFIERS))), F.split(v, " "))) > 0,
        "size_exact": (c("size") > 0) & (gap == 0), "size_close": (c("size") > 0) & (gap > 0) & (gap <= 10), "pack_same": (c("pack") > 0) & (c("pack") == c("a_pack")),
        "own_brand": F.coalesce(F.array_contains("own", c("a_brand")), F.lit(False)),
    })
    trusted = F.coalesce(((c("source") == "synonym") & (c("trust") >= 0.85)) | ((c("source") == "fuzzy") & (c("percent") >= 82)), F.lit(False))
    first = (
        F.when(c("any_token"), 3000).when(trusted, 0).otherwise(-1000) + F.when(c("every_token"), 1000).otherwise(0) - F.when(c("extra_color"), 1200).otherwise(0)
        + F.when(c("size_exact"), 2000).when(c("size_close"), 500).when((c("size") > 0) & (gap <= 20), -1000).otherwise(0) + F.when(c("species") == c("a_species"), 1500).otherwise(0)
        + F.when(c("species").isin("ROSES", "CARNATIONS") & (c("origin") == c("a_origin")) & (c("origin") != ""), 1500).otherwise(0) + F.when(c("pack_same"), 1000).otherwise(0)
    )
    d = d.withColumn("so_far", first.cast("int")).withColumn("peer", F.max(c("own_brand").cast("int")).over(Window.partitionBy("line_id")) == 1)
    foreign = (c("a_brand") != "") & ~c("own_brand")
    brand = F.when(c("own_brand"), 2500).when(foreign & c("a_brand").isin(hard), -2500).when(foreign & (c("so_far") >= 8000), -400).when(c("peer"), -1500).otherwise(0)
    history = F.when(c("used") >= 3, 1000).when(c("used") >= 1, 500).otherwise(0)
    trust = F.when(c("source") == "synonym", F.round(F.coalesce(c("trust"), F.lit(0.0)) * 2500).cast("int")).otherwise(0)
    prior = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIOR.items() for x in kv]), c("source")), F.lit(OTHER_PRIOR)) + F.when(c("source") == "fuzzy", 15 * F.coalesce("percent", F.lit(0))).otherwise(0)
    return d.withColumn("points", F.greatest(c("so_far") + brand + history + trust + prior, F.lit(0)).cast("int")).withColumn("score", F.floor((c("points") + 5) / 10).cast("int"))


def lifted(graded: DataFrame) -> DataFrame:
    """Scores after boost and pin: a clear winner with the provider's own brand, the right variety and size, and the article that a person confirmed, go to the top."""
    c = F.col
    line = Window.partitionBy("line_id")
    manual = F.max(F.when((c("source") == "synonym") & (c("status") == "manual_confirmado"), 1).otherwise(0)).over(line) == 1
    can = c("own_brand") & c("any_token") & c("size_exact")
    order = line.orderBy(can.desc(), c("pack_same").desc(), c("every_token").desc(), F.desc("score"), "article_id")
    d = graded.withColumn("manual", manual).withColumn("can", can).withColumn("at", F.row_number().over(order))
    rival = F.lead(F.struct("can", "pack_same", "every_token", "score")).over(order)
    top = F.max("score").over(line)
    top_place = F.row_number().over(line.orderBy(F.desc("score"), "article_id"))
    d = d.withColumn("rival", rival).withColumn("top", top).withColumn("top_place", top_place).withColumn("next", F.max(F.when(c("top_place") == 2, c("score"))).over(line))
    others = F.coalesce(F.when(c("top_place") == 1, c("next")).otherwise(c("top")), F.lit(0))
    clear = ~F.coalesce(c("rival.can"), F.lit(False)) | (c("pack_same") & ~c("rival.pack_same")) | (c("every_token") & ~c("rival.every_token")) | (c("score") > c("rival.score") + 50)
    boosted = c("can") & (c("at") == 1) & clear & ~c("manual")
    pinned = c("manual") & (c("source") == "synonym") & (c("status") == "manual_confirmado")
    raised = F.when(pinned, F.greatest(c("score"), F.lit(1100), others + 50)).when(boosted, F.greatest(c("score"), F.lit(1050), others + 50)).otherwise(c("score"))
    return d.withColumn("score", raised.cast("int")).drop("at", "rival", "top", "top_place", "next", "can", "manual")


def decide(lines: DataFrame, graded: DataFrame, catalogue: DataFrame) -> DataFrame:
    """line_id, article_id, source, score, margin, status and why, a row for every line.

    Of spray roses a confirmed link comes first, then articles with the whole variety, else the mixed spray of the size stands in. At 0.70 and over the best
    is linked, unless a rival of 0.70 or more is nearer than the margin (.02 from 1.05 on, .05 from 0.90 on, else .10). Then an exact
    size, a whole variety or no foreign colour decides, whichever side has it; else the line is ambiguous. From 0.50 on it's ambiguous if the
    variety speaks for it. Lines without a viable candidate are sin_match.
    """
    c = F.col
    mixto = catalogue.where("variety = 'SPRAY MIXTO' and pack = 10").groupBy(F.col("size")).agg(F.min("id").alias("mixto_id"))
    confirmed = F.coalesce((c("source") == "synonym") & c("status").isin("manual_confirmado", "aprendido_confirmado"), F.lit(False))
    group = F.when(~c("spray"), 0).when(confirmed, 0).when(c("every_token"), 1).otherwise(2)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), c("source"))
    place = F.row_number().over(Window.partitionBy("line_id").orderBy(group, F.desc("score"), rank, "article_id"))
    x = F.struct(group.alias("group"), "article_id", "source", "score", "size_exact", "size_close", "every_token", "any_token", "extra_color", F.coalesce("percent", F.lit(0)).alias("percent"))
    two = graded.withColumn("place", place).where("place <= 2").groupBy("line_id").agg(F.max(F.when(c("place") == 1, x)).alias("a"), F.max(F.when(c("place") == 2, x)).alias("b"))
    # a row a size
    j = lines.select("line_id", "spray", "size").join(dealt(two), "line_id", "left").join(F.broadcast(mixto), "size", "left")
    stand_in = c("spray") & c("a").isNotNull() & (c("a.group") == 2) & c("mixto_id").isNotNull()
    second = F.coalesce("b.score", F.lit(0))
    asked = F.when(c("a.score") >= 1050, 20).when(c("a.score") >= 900, 50).otherwise(100)
    near = (c("a.score") >= OK) & (c("a.score") - second < asked) & (second >= OK)
    swap = near & ((c("b.size_exact") & ~c("a.size_exact") & c("a.size_close")) | (c("b.every_token") & ~c("a.every_token")))
    j = j.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("margin", c("a.score") - second).withColumn("stand_in", stand_in).withColumn("swap", F.coalesce(swap, F.lit(False)))
    j = j.withColumn("w", F.when(c("swap"), c("b")).otherwise(c("a"))).withColumn("l", F.when(c("swap"), c("a")).otherwise(c("b")))
    why = F.when(c("w.size_exact") & ~c("l.size_exact") & c("l.size_close"), "size").when(c("w.every_token") & ~c("l.every_token"), "variety").when(c("l.extra_color") & ~c("w.extra_color"), "color")
    j = j.withColumn("why", F.when(c("near"), F.coalesce(why, F.lit(""))).otherwise(""))
    plausible = c("a.any_token") | (c("a.percent") >= 85) | (c("a.source") == "synonym")
    status = (
        F.when(c("a").isNull(), "sin_match").when(c("stand_in"), "ambiguous_match").when(c("a.score") >= OK, F.when(c("near") & (c("why") == ""), "ambiguous_match").otherwise("ok"))
        .when((c("a.score") >= DOUBTFUL) & plausible, "ambiguous_match").otherwise("sin_match")
    )
    j = j.withColumn("status", status)
    linked = c("status") != "sin_match"
    return j.select(
        "line_id", F.when(c("stand_in"), c("mixto_id")).when(linked, c("w.article_id")).alias("article_id"), F.when(c("stand_in"), F.lit("spray_mixto")).when(linked, c("w.source")).alias("source"),
        F.coalesce(F.when(c("stand_in"), F.lit(0)).otherwise(c("w.score")), F.lit(0)).alias("score"), F.coalesce(F.when(c("stand_in"), F.lit(0)).otherwise(c("margin")), F.lit(0)).alias("margin"), "status", F.when(linked & ~c("stand_in"), c("why")).otherwise("").alias("why"),
    )


def link(lines: DataFrame, catalogue: DataFrame, links: DataFrame, brands: DataFrame, hard: list[str], usage: DataFrame, fuzzy_hits: DataFrame | None = None) -> DataFrame:
    """Everything above in a row."""
    pairs = viable(beside(gather(lines, catalogue, links, brands, fuzzy_hits), lines, catalogue))
    return decide(lines, lifted(evidence(pairs, brands, hard, usage)), catalogue)


def score_event_updates(decisions: DataFrame) -> DataFrame:
    """What a run teaches: a link to add for each line that was linked by another source than a link itself."""
    return decisions.where("status = 'ok' and source <> 'synonym'").select("line_id", "article_id", F.lit("aprendido_en_prueba").alias("status"))

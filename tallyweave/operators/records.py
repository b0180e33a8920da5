"""Records over their life: aliases, patches, kept edits, moved keys, statistics, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names under which stored lines carry the same field, the first that is set counts.
ALIASES = {"line_total": ("line_total", "total_line", "total"), "match_confidence": ("match_confidence", "confidence"), "price_per_stem": ("price_per_stem", "price"), "pack": ("stems_per_bunch", "spb"), "raw": ("raw_description", "raw")}
# Words that change a colour.
MODIFIERS = ["OSCURO", "OSCURA", "CLARO", "CLARA", "LIGHT", "DARK", "PASTEL", "MEDIUM", "NEON", "BICOLOR"]


def unify(rows: DataFrame) -> DataFrame:
    """One column for each field from whichever of its aliases the table has."""
    own = [F.coalesce(*[F.col(a) for a in names if a in rows.columns]).alias(field) for field, names in ALIASES.items() if any(a in rows.columns for a in names)]
    known = {a for names in ALIASES.values() for a in names}
    return rows.select(*[c for c in rows.columns if c not in known], *own)


def serialise(lines: DataFrame) -> DataFrame:
    """Lines as they are shown: text cut at 120, prices at five places, totals at two, confidences at three."""
    return lines.select(
        "invoice", "line_no", "article_id", "provider_id", F.substring("raw", 1, 120).alias("raw"), F.round("price_per_stem", 5).alias("price"), F.col("amount").cast("string").alias("line_total"),
        F.round("extraction_confidence", 3).alias("confidence"), F.to_json(F.struct("match_status", "stems", "pack")).alias("state"),
    )


def restore(stored: DataFrame, schema: str, defaults: dict) -> DataFrame:
    """Lines from stored JSON: fields that are missing or of another type get defaults. ``stored``: value and any keys."""
    x = stored.withColumn("x", F.from_json("value", schema))
    fields = x.schema["x"].dataType.names
    return x.select(*[c for c in stored.columns if c != "value"], *[F.coalesce(F.col(f"x.{f}"), F.lit(defaults[f])).alias(f) if f in defaults else F.col(f"x.{f}").alias(f) for f in fields])


def confident(lines: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Lines with the confidence of their document; a rescued line has the lesser of that and its own. documents: key, confidence, source."""
    d = documents.select(key, F.col("confidence").alias("_c"), F.col("source").alias("_s"))
    rescued = F.col("extraction_source") == "rescue"
    j = lines.join(d, key, "left")
    c = F.coalesce(F.col("_c"), F.lit(1.0))
    return j.withColumn("extraction_confidence", F.when(rescued, F.least(c, "extraction_confidence")).otherwise(c)).withColumn("extraction_source", F.when(rescued, "rescue").otherwise(F.coalesce("_s", "extraction_source"))).drop("_c", "_s")


#: Fields that a patch may set; labels are kept in upper case, at most 64 letters.
PATCHABLE = ("stems", "bunches", "pack", "size", "variety", "label", "price_per_stem", "line_total")
NULL = "\0null"


def patch(lines: DataFrame, patches: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Fields that a patch sets replace the line's; others stay. Only PATCHABLE ones may be set; NULL sets a text field to null."""
    if wrong := [f for f in fields if f not in PATCHABLE]:
        raise ValueError(f"fields that can't be patched: {wrong}")
    p = patches.select(*keys, *[(F.upper(F.substring(F.col(f), 1, 64)) if f == "label" else F.col(f)).alias(f"new_{f}") for f in fields])
    text = {f for f in fields if patches.schema[f].dataType.simpleString() == "string"}
    new = lambda f: F.when(F.upper(f"new_{f}") == NULL.upper(), F.lit(None)).otherwise(F.coalesce(f"new_{f}", f)) if f in text else F.coalesce(f"new_{f}", f)
    return lines.join(p, keys, "left").select(*keys, *[new(f).alias(f) for f in fields])


def keep_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Freshly read lines with the edits of the stored ones, by equal text; deleted lines that aren't read again stay deleted.

    ``old``: doc_id, raw, label, deleted. ``new``: doc_id, raw, amount.
    """
    norm = F.lower(F.trim("raw"))
    edits = old.withColumn("k", norm).groupBy("doc_id", "k").agg(F.bool_or("deleted").alias("deleted"), F.max("label").alias("label"), F.min("raw").alias("raw"))
    fresh = new.withColumn("k", norm).join(edits.drop("raw"), ["doc_id", "k"], "left").select("doc_id", "k", "amount", "label", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    gone = edits.where("deleted").join(new.select("doc_id", norm.alias("k")), ["doc_id", "k"], "left_anti").select("doc_id", "k", F.lit(None).cast("double").alias("amount"), "label", "deleted")
    return fresh.union(gone)


def by_durable_key(wanted: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles by code, else by reference: wanted has want_id, code, reference; articles id, code, reference."""
    a = articles.groupBy("code").agg(F.min("id").alias("by_code"))
    b = articles.groupBy(F.upper("reference").alias("ref")).agg(F.min("id").alias("by_ref"))
    j = wanted.join(a, "code", "left").join(b, F.upper("reference") == F.col("ref"), "left")
    return j.select("want_id", F.coalesce("by_code", "by_ref").alias("id"), F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_ref").isNotNull(), "reference").otherwise("none").alias("how"))


def migrate_ids(links: DataFrame, articles: DataFrame) -> DataFrame:
    """New ids by name where a name is one article's only, else by the name without its last letter, under the same guard."""
    name = F.upper(F.trim("name"))
    one = articles.groupBy(name.alias("n")).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1").drop("c")
    cut = articles.groupBy(F.expr("substring(upper(trim(name)), 1, length(trim(name)) - 1)").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("cut_id")).where("c = 1").drop("c")
    j = links.withColumn("n", name).join(one, "n", "left").join(cut, "n", "left")
    return j.select("link_id", F.coalesce("id", "cut_id").alias("id"))


def merge_orphans(links: DataFrame, owners: DataFrame, rank: list[str]) -> DataFrame:
    """Links of provider 0 go to their article's provider; of equal keys the stronger status wins and uses add up, each once.

    ``links``: provider_id, variety, article_id, status, uses. ``owners``: article_id, owner.
    """
    moved = links.join(owners, "article_id", "left").withColumn("provider_id", F.when(F.col("provider_id") == 0, F.coalesce("owner", F.lit(0))).otherwise(F.col("provider_id")))
    place = F.array_position(F.array(*map(F.lit, rank)), F.col("status"))
    return moved.groupBy("provider_id", "variety").agg(F.min_by(F.struct("article_id", "status"), F.struct(place, F.col("article_id"))).alias("x"), F.sum("uses").alias("uses")).select("provider_id", "variety", "x.article_id", "x.status", "uses")


def rewrite_packs(links: DataFrame, old: int, new: int) -> DataFrame:
    """Links of one pack get another; where the new key is taken already, the moved link is dropped."""
    moved = links.withColumn("moved", F.col("pack") == old).withColumn("pack", F.when(F.col("pack") == old, new).otherwise(F.col("pack")))
    return moved.groupBy("variety", "size", "pack").agg(F.min_by("article_id", F.struct("moved", F.col("article_id"))).alias("article_id"), F.count(F.lit(1)).alias("n"))


def rebuild_name(name: Column, variety: Column, size: Column, pack: Column, brand: Column) -> Column:
    """A catalogue name that was cut off in storage, built again from its parts."""
    whole = F.concat_ws(" ", variety, F.format_string("%dCM", size), F.format_string("%dU", pack), F.nullif(brand, F.lit("")))
    return F.when(~name.rlike("[0-9]U") & whole.startswith(F.trim(name)), whole).otherwise(name)


def strip_suffix(name: Column, suffixes: list[str]) -> Column:
    return F.trim(F.regexp_replace(name, f"(?i)\\s+({'|'.join(suffixes)})\\s*$", ""))


def modifiers(variety: Column, name: Column) -> Column:
    """Colour modifiers that the name has and the variety lacks."""
    return F.array_sort(F.array_except(F.array_intersect(F.split(name, " "), F.array(*map(F.lit, MODIFIERS))), F.split(variety, " ")))


def confidence(link: Column, ocr: Column, extraction: Column) -> Column:
    """The product of three confidences; 0 means unknown and counts as 1."""
    known = lambda c: F.when(c == 0, 1.0).otherwise(c)
    return known(link) * known(ocr) * known(extraction)


def export_sql(links: DataFrame) -> DataFrame:
    """A statement for each link; links without an article become comments."""
    values = F.format_string("(%d, '%s', %d, %d)", "provider_id", F.replace("variety", F.lit("'"), F.lit("''")), "size", F.coalesce("article_id", F.lit(0)))
    return links.select("link_id", F.when(F.coalesce("article_id", F.lit(0)) == 0, F.concat(F.lit("-- pending "), values)).otherwise(F.concat(F.lit("INSERT INTO links VALUES "), values, F.lit(";"))).alias("statement"))


def keyword_owner(texts: DataFrame, owners: list[tuple[str, list[str]]]) -> DataFrame:
    """The first owner whose first three keywords are all in the text; a registry of some rows."""
    low = F.lower("text")
    case = F.coalesce(*[F.when(F.forall(F.array(*[F.lit(k.lower()) for k in keys[:3]]), lambda k: F.contains(low, k)), F.lit(owner)) for owner, keys in owners])
    return texts.select("doc_id", case.alias("owner")).where("owner is not null")


def majority_words(words: DataFrame, least_share: float = 0.5, most: int = 10) -> DataFrame:
    """Words in at least a share of a group's documents, the commonest first: group_id, rank, word, n_docs.

    ``words``: group_id, doc_id, word.
    """
    distinct = words.distinct()
    size = words.select("group_id", "doc_id").distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("docs"))
    n = distinct.groupBy("group_id", "word").agg(F.count(F.lit(1)).alias("n_docs")).join(size, "group_id").where(F.col("n_docs") >= least_share * F.col("docs"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n_docs"), "word"))).where(F.col("rank") <= most).select("group_id", "rank", "word", "n_docs")


def dominant(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Of each group the kind whose pattern occurs most, and its share; ties go to the earlier kind."""
    counts = texts.groupBy("group_id").agg(*[F.sum(F.regexp_count("text", F.lit(p))).alias(k) for k, p in patterns.items()])
    every = F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, k in enumerate(patterns)])
    total = sum((F.col(k) for k in patterns), F.lit(0))
    best = F.array_max(every)
    return counts.select("group_id", best["kind"].alias("kind"), best["n"].alias("hits"), F.coalesce(F.round(F.try_divide(best["n"].cast("double"), total), 4), F.lit(0.0)).alias("share"))


def top_corrections(log: DataFrame, k: int) -> DataFrame:
    """The pairs of key and article that were corrected most."""
    return log.where("kind = 'correct'").groupBy("key", "article_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key", "article_id").limit(k)


def ranking(findings: DataFrame, k: int = 30) -> DataFrame:
    """The commonest codes, by the part before a bracket."""
    return findings.groupBy(F.trim(F.split("code", r"\(")[0]).alias("code")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(k)


def free_text(rows: DataFrame, fields: list[str], asked: str) -> DataFrame:
    """Rows that hold the text in any of the fields, whatever the case."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(asked.lower())))


def triage(texts: DataFrame, providers: DataFrame) -> DataFrame:
    """How a folder of texts stands: empty, short, unknown or known provider. ``providers``: doc_id, provider."""
    j = texts.join(providers.select("doc_id", "provider"), "doc_id", "left")
    state = F.when(F.length(F.trim("text")) == 0, "empty").when(F.length("text") < 50, "short").when(F.col("provider").isNull(), "unknown").otherwise("known")
    return j.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(state == s).alias(s) for s in ("empty", "short", "unknown", "known")])

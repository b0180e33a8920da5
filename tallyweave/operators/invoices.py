"""Invoice checks, repairs, summaries and row transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks


def balance(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Sum of lines against the printed total; off by more than 1 % isn't ok. Invoices without lines aren't listed."""
    sums = lines.groupBy("invoice").agg(F.sum("amount").alias("s"))
    j = sums.join(headers, "invoice")
    off = F.abs(F.col("s") - F.col("header_total")) > checks.HEADER_TOLERANCE * F.col("header_total").cast("double")
    return j.select(
        "invoice", F.col("s").cast("double").alias("sum_lines"), F.col("header_total").cast("double").alias("header_total"),
        F.when(F.col("header_total") > 0, (F.col("s") - F.col("header_total")).cast("double")).alias("header_diff"), (~((F.col("header_total") > 0) & off)).alias("header_ok"),
    )


def repair_totals(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """A missing total, or one over 10 times or under a tenth of the lines' sum, becomes that sum."""
    sums = lines.groupBy("invoice").agg(F.sum("amount").alias("s"))
    j = headers.join(sums, "invoice", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    bad = (F.col("header_total") == 0) | ((F.col("s") > 0) & ((F.col("header_total") > F.col("s") * 10) | (F.col("header_total") * 10 < F.col("s"))))
    return j.select("invoice", F.when(bad, F.col("s")).otherwise(F.col("header_total")).cast("double").alias("total"), bad.alias("repaired"))


def line_findings(lines: DataFrame) -> DataFrame:
    return lines.select("invoice", "line_no", "article_id", "provider_id", F.explode(checks.line_errors()).alias("code"))


def lanes(lines: DataFrame) -> DataFrame:
    checked = lines.withColumn("errors", checks.line_errors())
    return checked.select("invoice", "line_no", "article_id", "provider_id", F.size("errors").alias("n_errors"), checks.review_lane(F.col("errors")).alias("lane"))


def kpis(lines: DataFrame) -> DataFrame:
    n = lambda cond: F.count_if(cond)
    s = F.col("match_status")
    checked = lines.withColumn("errors", checks.line_errors())
    return checked.groupBy("invoice").agg(
        F.count(F.lit(1)).alias("n_lines"), n(s == "ok").alias("n_ok"), n(s == "ambiguous_match").alias("n_ambiguous"), n(s == "sin_match").alias("n_unmatched"),
        n(F.col("extraction_source") == "rescue").alias("n_rescued"), n(checks.needs_review(F.col("errors"), 0.80, fuzzy=False)).alias("n_review"), F.sum("amount").cast("double").alias("total"),
    )


def batch_summary(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """One row over all invoices."""
    per = kpis(lines).join(balance(lines, headers), "invoice")
    return per.agg(
        F.count(F.lit(1)).alias("invoices"), F.sum("n_lines").alias("lines"), F.sum("n_ok").alias("ok"), F.sum("n_ambiguous").alias("ambiguous"), F.sum("n_unmatched").alias("unmatched"),
        F.sum("n_rescued").alias("rescued"), F.sum("n_review").alias("review"), F.count_if(~F.col("header_ok")).alias("unbalanced"), F.count_if(F.col("n_review") == 0).alias("clean_invoices"),
    )


def review_variants(lines: DataFrame) -> DataFrame:
    """The two review rules side by side, by status."""
    checked = lines.withColumn("errors", checks.line_errors())
    return checked.groupBy("match_status").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(checks.needs_review(F.col("errors"), 0.80, fuzzy=False)).alias("review_strict"), F.count_if(checks.needs_review(F.col("errors"), 0.84, fuzzy=True)).alias("review_wide")
    )


def split_mixed(lines: DataFrame) -> DataFrame:
    """A line of two varieties (A/B) becomes two with half of stems, bunches and amount; box lines stay whole."""
    two = (F.size(F.split("variety", "/")) == 2) & (F.col("box_type") != "MIX")
    parts = F.when(two, F.split("variety", "/")).otherwise(F.array("variety"))
    half = lambda c: F.when(F.col("halved"), F.floor(F.col(c) / 2).cast("int")).otherwise(F.col(c)).alias(c)
    out = lines.withColumn("halved", two).select("*", F.posexplode(parts).alias("part", "one"))
    return out.select(
        "invoice", "line_no", "article_id", "provider_id", "part", F.trim("one").alias("variety"), half("stems"), half("bunches"),
        F.when(F.col("halved"), F.round(F.col("amount") / 2, 2)).otherwise(F.col("amount")).cast("double").alias("line_total"), F.when(F.col("halved"), "MIX").otherwise(F.col("box_type")).alias("box_type"),
    )


def group_boxes(lines: DataFrame) -> DataFrame:
    """Lines of one mixed box (same text) become a parent with sums and children; other lines stand alone."""
    own = F.concat_ws(":", "line_no", "article_id", "provider_id", "stems", "line_total")
    keyed = lines.withColumn("group_key", F.when(F.col("box_type") == "MIX", F.concat(F.lit("box "), F.col("raw"))).otherwise(F.concat(F.lit("line "), own)))
    child = F.struct("line_no", "article_id", "provider_id", "stems")
    grouped = keyed.groupBy("invoice", "group_key").agg(F.min("line_no").alias("position"), F.count(F.lit(1)).alias("n_lines"), F.sum("stems").alias("stems"), F.sum("amount").cast("double").alias("line_total"), F.array_sort(F.collect_list(child)).alias("c"))
    children = F.when(F.col("n_lines") > 1, F.array_join(F.transform("c", lambda x: x["article_id"].cast("string")), ","))
    return grouped.select("invoice", "group_key", "position", "n_lines", "stems", "line_total", children.alias("children"))


def rescue(text: DataFrame, parsed: DataFrame, product: str, noise: str, price: str, least: int = 10) -> DataFrame:
    """Lines that look like products but weren't parsed: doc_id, line_no, raw.

    ``text``: doc_id, line_no, line. ``parsed``: doc_id, raw, variety of what was parsed. A line isn't rescued if it is a parsed
    raw text, or holds a parsed variety of four or more characters.
    """
    c = F.trim(F.col("line"))
    seen = text.select("doc_id", "line_no", c.alias("raw")).where((F.length(c) >= least) & c.rlike(f"(?i){product}") & ~c.rlike(f"(?i){noise}") & c.rlike(price))
    done = parsed.groupBy("doc_id").agg(F.collect_set(F.trim("raw")).alias("raws"), F.collect_set(F.upper(F.trim("variety"))).alias("varieties"))
    j = seen.join(done, "doc_id", "left")
    held = F.exists(F.coalesce("raws", F.array().cast("array<string>")), lambda r: (r != "") & F.contains(F.col("raw"), r)) | F.exists(
        F.coalesce("varieties", F.array().cast("array<string>")), lambda v: (F.length(v) >= 4) & F.contains(F.upper("raw"), v)
    )
    return j.where(~held).select("doc_id", "line_no", "raw")


def reclassify(lines: DataFrame, assorted: str) -> DataFrame:
    """Unmatched or ambiguous lines whose variety means an assortment are mixed boxes."""
    hit = F.col("match_status").isin("sin_match", "ambiguous_match") & F.trim("variety").rlike(f"(?i){assorted}")
    return lines.withColumn("match_status", F.when(hit, "mixed_box").otherwise(F.col("match_status")))


def order_sheets(lines: DataFrame, headers: DataFrame, existing: DataFrame) -> DataFrame:
    """Order lines of invoices that have no sheet yet: linked lines only, bunches at least one."""
    fresh = lines.where("match_status = 'ok' and article_id is not null").join(existing.select("invoice", "provider_id"), ["invoice", "provider_id"], "left_anti").join(headers, "invoice", "left_semi")
    return fresh.select("invoice", "provider_id", "line_no", "article_id", F.col("stems").alias("units"), F.greatest("bunches", F.lit(1)).alias("packs"), F.col("line_total").alias("price"))


def upsert_latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key wins."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def page_confidence(pages: DataFrame) -> DataFrame:
    """Triage of pages by their text, and the document's confidence weighted by characters.

    ``pages``: doc_id, page_no, text, confidence. A document without any native page has only scans.
    """
    chars, words = F.length("text"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    letters = F.length(F.regexp_replace("text", "[^A-Za-z0-9]", ""))
    native = (chars >= 40) & (words >= 15) & (letters >= 0.35 * chars)
    p = pages.withColumn("chars", chars).withColumn("native", native)
    weight = F.greatest("chars", F.lit(1))
    return p.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if("native").alias("n_native"), F.sum("chars").alias("n_chars"),
        (F.sum((F.col("confidence") * weight).cast("decimal(38,4)")).cast("double") / F.sum(weight)).alias("confidence"), F.when(F.count_if("native") == F.count(F.lit(1)), "native").when(F.count_if("native") > 0, "mixed").otherwise("scan").alias("source"),
    )

"""Prices against history, the log of proposals and decisions, learned links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks

PRICE_TOLERANCE = 0.15
WINDOW_SHEETS = 20


def recent_prices(lines: DataFrame, sheets: int = WINDOW_SHEETS) -> DataFrame:
    """Mean price of each provider's articles over its last sheets (the largest numbers)."""
    # distinct numbers first: the window sees a row a sheet, not a row a line
    numbers = lines.select("provider_id", "invoice").distinct()
    last = numbers.withColumn("n", F.row_number().over(Window.partitionBy("provider_id").orderBy(F.desc("invoice")))).where(F.col("n") <= sheets)
    used = lines.where("stems > 0").join(last.select("provider_id", "invoice"), ["provider_id", "invoice"])
    return used.groupBy("provider_id", "article_id").agg(F.avg(F.col("amount").cast("double") / F.col("stems")).alias("reference"))


def reconcile(lines: DataFrame, sheets: int = WINDOW_SHEETS) -> DataFrame:
    """Linked lines against the recent price of their article: change in percent, and how severe."""
    j = lines.where("match_status = 'ok' and stems > 0 and amount > 0").join(recent_prices(lines, sheets), ["provider_id", "article_id"]).where("reference > 0")
    change = F.col("amount").cast("double") / F.col("stems") / F.col("reference") - 1
    level = F.when(F.abs(F.col("change")) > 2 * PRICE_TOLERANCE, "severe").when(F.abs(F.col("change")) > PRICE_TOLERANCE, "notable").otherwise("none")
    return j.withColumn("change", F.round(change, 4)).select("invoice", "line_no", "article_id", "provider_id", F.round("reference", 4).alias("reference"), "change", level.alias("deviation"))


def timeline(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Price statistics of each article and month, and how many prices lie over 2 deviations from the article's mean."""
    price = F.col("amount").cast("double") / F.col("stems")
    j = lines.where("stems > 0").join(headers.select("invoice", "dated"), "invoice").select("article_id", F.date_trunc("month", "dated").cast("date").alias("month"), price.alias("price"))
    stats = j.groupBy("article_id").agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("deviation"))
    far = F.abs(F.col("price") - F.col("mean")) > 2 * F.col("deviation")
    return j.join(stats, "article_id").groupBy("article_id", "month").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"), F.min("price").alias("low"), F.max("price").alias("high"), F.count_if(far).alias("n_far"))


def asof(log: DataFrame) -> DataFrame:
    """Each decision with the latest proposal of its key at or before it; decisions without one stay.

    One sort by key and time; the last proposal is carried along, so neither side is joined.
    """
    order = Window.partitionBy("key").orderBy("ts", F.when(F.col("kind") == "proposal", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    proposal = F.last(F.when(F.col("kind") == "proposal", F.struct(F.col("event_id").alias("id"), "confidence", "article_id", F.col("ts").alias("at"))), ignorenulls=True).over(order)
    known = log.where(F.col("kind").isin("proposal", "confirm", "correct")).withColumn("p", proposal)
    return known.where("kind <> 'proposal'").select("event_id", "key", "kind", F.col("p.id").alias("proposal_id"), F.col("p.confidence").alias("proposed_confidence"), F.col("p.article_id").alias("proposed_article"))


def accuracy(log: DataFrame) -> DataFrame:
    """Confirmed against corrected proposals of each key; corrections without a proposal are rescues and don't count."""
    m = asof(log)
    had = F.col("proposal_id").isNotNull()
    counts = m.groupBy("key").agg(F.count_if((F.col("kind") == "confirm") & had).alias("confirmed"), F.count_if((F.col("kind") == "correct") & had).alias("corrected"), F.count_if(~had).alias("rescued"))
    return counts.withColumn("accuracy", F.round(F.try_divide(F.col("confirmed").cast("double"), F.col("confirmed") + F.col("corrected")), 4))


def backlog(log: DataFrame) -> DataFrame:
    """Latest proposal of each key and article that nobody has decided on."""
    p = log.where("kind = 'proposal'").groupBy("key", "article_id").agg(F.max_by(F.struct("event_id", "confidence"), F.struct("ts", F.col("event_id"))).alias("x"))
    decided = log.where(F.col("kind").isin("confirm", "correct")).select("key", "article_id").distinct()
    return p.join(decided, ["key", "article_id"], "left_anti").select("key", "article_id", "x.event_id", "x.confidence")


def missing_articles(log: DataFrame) -> DataFrame:
    """What the catalogue may lack: 3 points a correction, 1 a pending proposal; with the first suggestion."""
    points = log.groupBy("article_id").agg(F.count_if(F.col("kind") == "correct").alias("rescues"), F.count_if(F.col("kind") == "proposal").alias("pending"), F.min_by("key", F.struct("ts", "event_id")).alias("first_key"))
    return points.withColumn("score", 3 * F.col("rescues") + F.col("pending"))


def fold(log: DataFrame) -> DataFrame:
    """Learned links by their whole history: key, article_id, counters, status, trust.

    Corrections add up for life: one makes a link ambiguous, two reject it, and no confirmation takes that back. A link on trial is
    confirmed by a person's confirmation or by the second hit. So the state follows from sums, in whatever order the events come.
    """
    known = log.where(F.col("kind") != "other")
    c = known.groupBy("key", "article_id").agg(F.count_if(F.col("kind") == "confirm").alias("confirmed"), F.count_if(F.col("kind") == "correct").alias("corrected"), F.count_if(F.col("kind") == "proposal").alias("hits"), F.count(F.lit(1)).alias("n_events"))
    status = F.when(F.col("corrected") >= 2, "rechazado").when(F.col("corrected") == 1, "ambiguo").when((F.col("confirmed") >= 1) | (F.col("hits") >= 2), "aprendido_confirmado").otherwise("aprendido_en_prueba")
    return c.withColumn("status", status).withColumn("trust", checks.trust(F.col("status"), F.col("confirmed"), F.col("corrected")))


def replay(log: DataFrame) -> DataFrame:
    """Learned links by their history and by what people said of them: key, article_id, confirmed, corrected, hits, status, trust; one article a key.

    ``log``: key, article_id, kind, ts; kinds as in ``fold``, and ``manual`` (a person chose this article) and ``delete`` (a person took the link away). Nothing before a key's
    last delete counts. The last manual choice stands against all that runs learn; corrections of its article after it make it ambiguous, two reject it. Without one
    the article with the most trust is linked, then the one with the smaller id. At equal times a delete comes first, then a manual choice.
    Only latest times and sums are needed, so events may come in any order.
    """
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ts")))
    chosen = F.max_by(F.when(F.col("kind") == "manual", F.col("article_id")), F.when(F.col("kind") == "manual", F.struct("ts", -F.col("article_id"))))
    people = log.where(F.col("kind").isin("manual", "delete")).groupBy("key").agg(last("delete").alias("gone"), last("manual").alias("said"), chosen.alias("chosen"))
    people = people.withColumn("manual", F.col("said").isNotNull() & (F.col("gone").isNull() | (F.col("said") >= F.col("gone"))))
    t = log.where(~F.col("kind").isin("manual", "delete")).join(people, "key", "left").where("gone is null or ts > gone")
    # of a chosen article only what was said after the choice counts
    counted = F.coalesce(~F.col("manual") | ((F.col("article_id") == F.col("chosen")) & (F.col("ts") >= F.col("said"))), F.lit(True))
    learned = fold(t.where(counted).select("key", "article_id", "kind")).drop("n_events", "trust")
    best = F.max(F.struct(checks.trust(F.col("status"), F.col("confirmed"), F.col("corrected")).alias("trust"), (-F.col("article_id")).alias("minus"), "confirmed", "corrected", "hits", "status")).alias("x")
    learned = learned.groupBy("key").agg(best).select("key", (-F.col("x.minus")).alias("article_id"), "x.confirmed", "x.corrected", "x.hits", "x.status")
    by_hand = people.where("manual").select("key", "chosen")
    j = learned.join(by_hand, "key", "full")
    corrected = F.coalesce("corrected", F.lit(0))
    state = F.when(corrected >= 2, "rechazado").when(corrected == 1, "ambiguo").otherwise("manual_confirmado")
    j = j.withColumn("status", F.when(F.col("chosen").isNotNull(), state).otherwise(F.col("status"))).withColumn("article_id", F.coalesce("chosen", "article_id"))
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("confirmed", "corrected", "hits")]
    j = j.select("key", "article_id", *numbers, "status")
    return j.withColumn("trust", checks.trust(F.col("status"), F.col("confirmed"), F.col("corrected")))


def fold_counts(log: DataFrame) -> DataFrame:
    return fold(log).drop("n_events")


def fold_events(log: DataFrame) -> DataFrame:
    return fold(log).select("key", "article_id", "status", "n_events")


def audit(links: DataFrame) -> DataFrame:
    """Varieties and sizes that are linked to more than one article."""
    return links.groupBy("variety", "size").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("article_id").alias("n_articles"), F.min("article_id").alias("first_id")).where("n_articles > 1")


def usage(lines: DataFrame) -> DataFrame:
    """How often a provider's article was linked and not rejected."""
    return lines.where("match_status <> 'sin_match'").groupBy("provider_id", "article_id").agg(F.count(F.lit(1)).alias("n"))

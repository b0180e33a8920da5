"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 48-bit hash of its id. A source takes all its documents a whole number of times, and
once more those below a threshold. The threshold is found from histograms: sizes are summed by source and the
hash's first 12 bits, the bucket is found in which the budget ends, and only that bucket is split by the next
12 bits, down to single hashes. Rows are never sorted; what is shuffled are sums.

Defined cases: null and empty texts have size 0; a null source is a source of its own, named last. Documents of
size 0 take 0. Rows with the same doc_id share a hash and are taken or left together; a null doc_id has the
hash of the empty string. An empty table gives an empty result. Very long texts are counted whole. ``mix`` reads doc_id, text and source only,
whatever other columns are named; ``mixed`` returns all columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
LEVELS, BITS = 4, 12


def document_hash(doc_id: Column) -> Column:
    """The first 48 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), document_hash(F.col("doc_id")).alias("h"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target. One row a source: windows over all of them are small.

    A target is min(3 * size, level * weight), with the level at which they sum to the whole; sources are
    capped in order of 3 * size / weight. The first source in that order that needn't be capped gives the level,
    which is the highest of those that such sources would give.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), kind + 1)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = totals.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * MOST_REPEATS)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("all_size", F.sum("source_size").over(all_rows)).withColumn("all_w", F.sum("w").over(all_rows))
    t = t.withColumn("rest", F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("rest_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("rest") / F.col("rest_w"))
    t = t.withColumn("open", F.col("cap") / F.col("w") >= F.col("level"))
    t = t.withColumn("at", F.max(F.when(F.col("open"), F.col("level"))).over(all_rows))
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("w"), "cap")).alias("target"))


def thresholds(sized: DataFrame) -> DataFrame:
    """source, source_size, target, whole (times that all is taken) and below (hashes under it are taken once more)."""
    t = targets(sized)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_REPEATS))).otherwise(0).cast("long"))
    t = materialize(t.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")), "targets")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        of = t.select(F.col("source").alias("s"), "prefix")
        mine = sized.where("size > 0").join(of, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        histogram = mine.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s").orderBy("bucket")
        summed = histogram.withColumn("upto", F.sum("n").over(run)).join(t.select(F.col("source").alias("ts"), "left"), F.col("s").eqNullSafe(F.col("ts"))).drop("ts")
        # the last level's bucket is one hash: it's taken if that ends nearer to the budget
        ends = F.col("upto") > F.col("left") if level < LEVELS - 1 else F.col("upto") - F.col("n") / 2.0 > F.col("left")
        at = summed.where(ends).groupBy("s").agg(F.min("bucket").alias("bucket"), F.min_by(F.col("upto") - F.col("n"), "bucket").alias("used"))
        t = t.join(at, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "whole", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
            # no bucket passes the budget: what is left of this prefix is taken, so the border is its end
            F.coalesce("bucket", F.shiftleft(F.col("prefix") + 1, BITS)).alias("prefix"),
        )
        t = materialize(t, "targets")
    return t.select("source", "source_size", "target", "whole", F.col("prefix").alias("below"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, times and taken for each row."""
    sized = materialize(sizes(docs), "sizes")
    t = thresholds(sized).withColumnRenamed("source", "s")
    times = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).otherwise(0).cast("int")
    out = sized.join(t, F.col("source").eqNullSafe(F.col("s"))).withColumn("times", times)
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"), "h", "below", "whole")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: a row for each time."""
    sized = materialize(sizes(docs), "sizes")
    # one row a source, and looked up by it: the texts themselves aren't shuffled unless sources are very many
    t = thresholds(sized).select(F.col("source").alias("_tw_s"), F.col("whole").alias("_tw_whole"), F.col("below").alias("_tw_below"))
    counted = F.regexp_like("text", F.lit(WORD_PATTERN))
    times = F.when(counted, F.col("_tw_whole") + F.when(document_hash(F.col("doc_id")) < F.col("_tw_below"), 1).otherwise(0)).otherwise(0).cast("int")
    out = docs.join(t, F.col("source").eqNullSafe(F.col("_tw_s"))).withColumn("_tw_times", times).where("_tw_times > 0")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), "_tw_times")).alias("_tw_n")).drop("_tw_n")

"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, release


def _large_star(links: DataFrame, most: int) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_counted(both, least, "u", most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, most: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_counted(down, least, "u", most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of a link; root is the component's smallest node.

    ``links``: columns a, b of type long, in any order and number; links of a node to itself are ignored.
    Every round writes its links to the shared folder, so the plan stays short and lost executors cost one round.
    The rounds grow with the logarithm of the longest path. The hub of a star, whatever its links, weighs on no single task.
    """
    links = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    now = materialize(links, "links")
    mark = _mark(now)
    while mark[0]:
        most = 2 * mark[0]  # rows of either star
        after = materialize(_small_star(_large_star(now, most), most), "links")
        release(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

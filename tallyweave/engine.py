"""One object for what a user does with documents, lines and links; every method gives or takes DataFrames."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import canonical
from .operators import history, linker, linking, registry, reports
from .sources import files

KEY = ("provider_id", "species", "variety_key", "size", "pack", "grade")


class Engine:
    """``root``: a folder that the driver and all executors share; it holds versions of the links and the log of decisions.

    ``catalogue``, ``brands``, ``usage`` and ``hard`` are as ``operators.linker`` has them.
    """

    def __init__(self, spark: SparkSession, root: str, catalogue: DataFrame, layouts: DataFrame, brands: DataFrame, usage: DataFrame, hard: list[str]):
        self.spark, self.root, self.catalogue, self.layouts, self.brands, self.usage, self.hard = spark, root, catalogue, layouts, brands, usage, hard

    # --- documents

    def process(self, texts: DataFrame, detected: DataFrame) -> DataFrame:
        """Rows of texts (doc_id, text) whose layout (doc_id, fmt) is known."""
        return registry.parse(registry.by_layout(texts, detected), self.layouts)

    def detect(self, texts: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
        return linking.detect(texts, patterns)

    def switch(self, names: list[str], on: bool) -> None:
        """Activate or deactivate layouts."""
        self.layouts = registry.activate(self.layouts, names, on)

    # --- links

    def link(self, lines: DataFrame, fuzzy_hits: DataFrame | None = None) -> DataFrame:
        """A decision for each line, against the links as they are now."""
        return linker.link(lines, self.catalogue, self.links(), self.brands, self.hard, self.usage, fuzzy_hits)

    def links(self) -> DataFrame:
        """The newest version of the learned links, with the state and trust that their events give."""
        return files.load_store(self.spark, f"{self.root}/links")

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/events")

    def tell(self, lines: DataFrame, articles: DataFrame, kind: str, ts: str) -> None:
        """Log what a person or a run says of lines: kind is proposal, confirm or correct. ``articles``: line_id, article_id."""
        e = lines.select("line_id", "provider_id", "species", canonical(F.col("variety")).alias("variety_key"), "size", "pack", F.upper("grade").alias("grade")).join(articles, "line_id")
        e.select(*KEY, "article_id", F.lit(kind).alias("kind"), F.lit(ts).alias("ts")).write.mode("append").parquet(f"{self.root}/events")

    def _say(self, keys: DataFrame, kind: str, ts: str | None) -> None:
        """Log what a person did: keys and, for ``manual``, article_id."""
        when = F.lit(ts) if ts else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS")
        article = F.col("article_id") if "article_id" in keys.columns else F.lit(None)
        keys.select(*KEY, article.cast("long").alias("article_id"), F.lit(kind).alias("kind"), when.alias("ts")).write.mode("append").parquet(f"{self.root}/events")

    def learn(self, version: int) -> DataFrame:
        """A new version of the links: each key by all its events, people's choices included; links that no event speaks of stay as they are."""
        e = self.events().withColumn("key", F.struct(*KEY)).select("key", "article_id", "kind", "ts")
        known = history.replay(e).select("key.*", "article_id", "status", "trust")
        columns = [*KEY, "article_id", "status", "trust"]
        rest = self.links().join(e.select("key.*").distinct(), list(KEY), "left_anti") if self._has_links() else known.limit(0)
        files.save_store(known.select(columns).unionByName(rest.select(columns)), f"{self.root}/links", version)
        return self.links()

    def _has_links(self) -> bool:
        try:
            self.links()
        except (FileNotFoundError, Py4JJavaError):  # no folder yet, or none that was committed
            return False
        return True

    def delete(self, keys: DataFrame, version: int, ts: str | None = None) -> DataFrame:
        """A version of the links without some keys; what was said of them before no longer counts."""
        self._say(keys, "delete", ts)
        files.save_store(self.links().join(keys.select(*KEY), list(KEY), "left_anti"), f"{self.root}/links", version)
        return self.links()

    def apply(self, corrections: DataFrame, version: int, ts: str | None = None) -> DataFrame:
        """Corrections of links by key: action delete, ok or repoint (to new_id). Gives those that can't be applied, with the reason; a new version has the others."""
        known = self.catalogue.select(F.col("id").alias("new_id"), F.lit(True).alias("exists")).dropDuplicates(["new_id"])
        c = corrections.join(self.links().select(*KEY, F.lit(True).alias("linked")), list(KEY), "left").join(known, "new_id", "left")
        why = (
            F.when(F.col("linked").isNull(), "no such link").when(~F.col("action").isin("delete", "ok", "repoint"), "no such action")
            .when((F.col("action") == "repoint") & F.col("exists").isNull(), "no such article")
        )
        c = c.withColumn("error", why)
        good = c.where("error is null").select(*KEY, "action", "new_id")
        j = self.links().join(good, list(KEY), "left")
        self._say(j.where("action = 'delete'"), "delete", ts)
        j = j.where("action is null or action <> 'delete'").withColumn("article_id", F.when(F.col("action") == "repoint", F.col("new_id")).otherwise(F.col("article_id")))
        said = F.col("action").isNotNull()
        self._say(j.where(said), "manual", ts)
        rows = j.select(*KEY, "article_id", F.when(said, "manual_confirmado").otherwise(F.col("status")).alias("status"), F.when(said, 0.98).otherwise(F.col("trust")).alias("trust"))
        files.save_store(rows, f"{self.root}/links", version)
        return c.where("error is not null").select(*KEY, "action", "new_id", "error")

    # --- questions

    def lookup(self, queries: list[str], limit: int = 10) -> DataFrame:
        return linking.search(self.catalogue.select("id", "name", F.lit("").alias("reference")), queries, limit)

    def relink(self, lines: DataFrame, before: DataFrame) -> DataFrame:
        """Decisions anew, and what changed by invoice. ``lines`` also has invoice; ``before``: line_id, article_id, status."""
        now = self.link(lines).select("line_id", "article_id", "status")
        of = lambda d: d.join(lines.select("line_id", "invoice"), "line_id").select("invoice", F.col("line_id").alias("line"), "article_id", F.col("status").alias("match_status"))
        return reports.restats(of(before), of(now))

    def kpis(self) -> DataFrame:
        return reports.link_kpis(self.links())

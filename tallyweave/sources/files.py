"""Files: tolerant JSON lines, SQL dumps, ZIP archives, retention."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "ts string, evento string, synonym_key string, provider_id int, species string, variety string, size int, stems_per_bunch int, grade string, proposed_articulo_id long, pdf string, invoice string, line_idx int, match_status string, link_confidence double, review_lane string, action string, decided_articulo_id long"


def read_events(spark: SparkSession, path: str, since: str | None = None, provider: int | None = None) -> DataFrame:
    """The decision log. Lines that aren't JSON objects are left out; a field of the wrong type is null. The same rows whatever columns are read."""
    kept = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())
    rows = kept.select(F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("x")).select("x.*")
    rows = rows if since is None else rows.where(F.col("ts") >= since)
    return rows if provider is None else rows.where(F.col("provider_id") == provider)


def checked_events(rows: DataFrame) -> DataFrame:
    """Events that say what their kind must say: a proposal its article, a decision its action; each has a time and a key."""
    proposal = (F.col("evento") == "propuesta") & F.col("proposed_articulo_id").isNotNull()
    decision = (F.col("evento") == "decision") & F.col("action").isNotNull()
    return rows.where(F.col("ts").isNotNull() & F.col("synonym_key").isNotNull() & (proposal | decision))


def list_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Files below a folder by suffix, in either case, ordered by name without regard to case: path, name, bytes. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), "bytes").where(F.lower("name").endswith(suffix)).orderBy(F.lower("name"), "path")


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """A report as CSV with a header, or as JSON lines; replaced as a whole."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def save_store(rows: DataFrame, root: str, version: int) -> None:
    """A version of a store (links, statuses): whole or not there at all, as readers take the newest that was committed. Older ones stay for running readers."""
    rows.write.parquet(f"{root}/version={version}")


def load_store(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed version of a store."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top) if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"no committed version in {root}")
    return spark.read.parquet(f"{root}/version={max(done)}")


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def dump_rows(lines: DataFrame, fields: str, least: int = 10) -> DataFrame:
    """Rows of an SQL dump: lines that begin with a bracket, values quoted by ' with \\ as escape; NULL is null.

    ``lines``: value. ``fields``: names and types as DDL. Rows of fewer than ``least`` values are left out.
    """
    body = F.regexp_replace(F.regexp_replace(F.trim("value"), r"^\(", ""), r"\)[,;]?$", "")
    options = {"sep": ",", "quote": "'", "escape": "\\", "nullValue": "NULL", "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE"}
    marks = F.regexp_replace(body, r"'(?:[^'\\]|\\.)*'", "")
    enough = F.length(marks) - F.length(F.replace(marks, F.lit(","))) + 1 >= least
    rows = lines.where(F.trim("value").startswith("(")).where(enough)
    return rows.select(F.from_csv(body, fields, options).alias("r")).select("r.*")


def unzip(archives: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """Members of ZIP archives by suffix: name (without folders; repeated names get a number) and content.

    ``archives``: what ``binaryFile`` gives. An archive that can't be read gives no rows, nor does a member that is broken or encrypted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                seen: dict[str, int] = {}
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            name = m.filename.replace("\\", "/").rsplit("/", 1)[-1]
                            if name.lower().endswith(suffix):
                                n = seen[name] = seen.get(name, 0) + 1
                                stem, dot, end = name.rpartition(".")
                                try:
                                    content = z.read(m)
                                except (RuntimeError, NotImplementedError, EOFError, zipfile.BadZipFile, zlib.error):
                                    continue
                                yield pd.DataFrame({"path": [path], "name": [name if n == 1 else f"{stem}_{n}{dot}{end}"], "content": [content]})
                except (zipfile.BadZipFile, TypeError):
                    continue

    return archives.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def skipped(name: Column, patterns: list[str]) -> Column:
    """Whether a file is logistics: its first word begins with a pattern; names that begin with a digit never are."""
    first = F.upper(F.regexp_extract(name, "[A-Za-z0-9]+", 0))
    return ~name.rlike("^[0-9]") & F.exists(F.array(*map(F.lit, patterns)), lambda p: first.startswith(p))


def expired(rows: DataFrame, days: int) -> DataFrame:
    """Rows over ``days`` days older than the newest; ``rows`` has ts."""
    newest = rows.agg(F.max("ts").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("ts") < F.col("newest") - F.make_interval(days=F.lit(days))).drop("newest")


def word_rows(words: DataFrame, tolerance: float) -> DataFrame:
    """Words with places to lines of text: page, band of heights, text from left to right."""
    band = F.round(F.col("top") / (2 * tolerance)).cast("long")
    word = F.struct("x0", "text")
    return words.groupBy("page", band.alias("band")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["text"]), " ").alias("text"))

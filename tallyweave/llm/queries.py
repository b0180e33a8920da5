"""The queries of the training-data operators, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_in_middle, html_wrapper, line_dedup, lm, media, mixing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, vector_codes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, keep_ids=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"), keep_media=False)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(table(spark, sf_dir, "documents"), keep_output=False).drop("output")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_html_extraction, op3_bpe, op4_quality_rules, op5_simhash, op6_mixing, op7_media, op8_lm_scoring, op9_pii, op10_quality_classifier, op11_fill_in_middle, op12_suffix_dedup, op13_vector_codes)
}


def _lloyd_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Lloyd's rounds, one after the other, each with all distances."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (SELECT x.row, x.part, arg_min(b.entry, (x.size - 2 * list_dot_product(x.v, b.v) + b.size, b.entry)) AS entry,
  min(x.size - 2 * list_dot_product(x.v, b.v) + b.size) AS far FROM parts x JOIN book{r} b USING (part) GROUP BY x.row, x.part)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (SELECT part, entry, list(floor(total / n) ORDER BY i) AS v FROM (SELECT part, entry, i, sum(x) AS total, count(*) AS n
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{r} JOIN parts USING (row, part)) GROUP BY ALL) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT part, entry, v, list_dot_product(v, v) AS size FROM (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m USING (part, entry)))""")
    return f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, part, v, list_dot_product(v, v) AS size FROM (
  SELECT row, p.part, v[p.part * len(v) // 4 + 1:(p.part + 1) * len(v) // 4] AS v FROM kept, (SELECT unnest(range(4)) AS part) p)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v, size FROM parts WHERE row <= 256),{",".join(steps)},
sha AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS sha FROM (
  SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM book{rounds})),
coded AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
  FROM near{rounds} JOIN kept USING (row) GROUP BY row, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded, sha"""


_LINES = r"""
lines AS (SELECT doc_id, u.i, u.line FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i) u),
keyed AS (SELECT *, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS trimmed FROM lines),
lowered AS (SELECT *, translate(trimmed, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM keyed),
often AS (SELECT key, max(doc_id) AS holder FROM lowered WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.i, l.line, o.key IS NOT NULL AND l.doc_id <> o.holder AS gone FROM lowered l LEFT JOIN often o ON l.key = o.key)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""WITH {_LINES}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_mixing": r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM totals),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, coalesce(max(level) FILTER (cap / w >= level) OVER () * w, cap)) AS target FROM levels),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM targets),
hashes AS (SELECT source, h, sum(size) AS n FROM sized WHERE size > 0 GROUP BY source, h),
summed AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
below AS (SELECT w.source, min(s.h) FILTER (s.upto - s.n / 2.0 > w.target - w.whole * w.source_size) AS below
  FROM whole w JOIN summed s ON s.source IS NOT DISTINCT FROM w.source GROUP BY w.source)
SELECT d.doc_id, d.size, w.source_size, w.target,
  CASE WHEN d.size > 0 THEN d.size * (w.whole + CASE WHEN d.h < coalesce(b.below, 281474976710656) THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS taken
FROM sized d JOIN whole w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN below b ON b.source IS NOT DISTINCT FROM d.source""",
    "op11_fill_in_middle": r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex,
  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
drawn AS (SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
  ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM hashed),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
  array_to_string(units[high + 1:n], '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256 FROM parts""",
    "op13_vector_codes": _lloyd_sql(),
    "op12_suffix_dedup": """
WITH bodies AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS hex FROM documents),
sized AS (SELECT *, length(hex) // 2 AS n FROM bodies),
slices AS (SELECT row, doc_id, n, j * 1000 AS base, substr(hex, j * 2000 + 1, 2098) AS slice
  FROM (SELECT row, doc_id, n, hex, unnest(range((n + 999) // 1000)) AS j FROM sized WHERE n >= 50)),
strings AS (SELECT row, doc_id, base + i AS start, md5(substr(slice, i * 2 + 1, 100)) AS string
  FROM (SELECT *, unnest(range(least(1000, n - 49 - base))) AS i FROM slices WHERE n - 49 - base > 0)),
least AS (SELECT string, min(doc_id) AS doc_id FROM strings GROUP BY string HAVING count(*) > 1),
hits AS (SELECT s.row, s.start FROM strings s JOIN least l USING (string) WHERE l.doc_id < s.doc_id),
fresh AS (SELECT row, start, (start > coalesce(lag(start) OVER (PARTITION BY row ORDER BY start) + 50, -1))::INT AS is_new FROM hits),
runs AS (SELECT row, min(start) AS a, max(start) + 50 AS b FROM (SELECT row, start, sum(is_new) OVER (PARTITION BY row ORDER BY start) AS run FROM fresh) GROUP BY row, run),
kept AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS since FROM runs),
left_ AS (SELECT k.row, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(s.hex, since * 2 + 1, (a - since) * 2), '' ORDER BY a) AS head
  FROM kept k JOIN sized s USING (row) GROUP BY k.row)
SELECT s.doc_id, s.n::BIGINT AS n_bytes, coalesce(l.n_removed, 0)::BIGINT AS n_removed, coalesce(l.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(l.head, '') || substr(s.hex, coalesce(l.last, 0) * 2 + 1))) AS kept_sha256 FROM sized s LEFT JOIN left_ l USING (row)""",
}

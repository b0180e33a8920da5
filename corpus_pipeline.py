"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Quality rules drop rejected documents, line dedup cuts repeated lines, of near copies (5-word
shingles, Jaccard likeness of 0.8 or more) one stays, sources are mixed to
target weights (a document taken twice is two rows), and the rest is encoded. Stages keep the columns of documents
but the last, which returns doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of the mix.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import bpe, line_dedup, mixing, quality_rules
from tallyweave.llm import near_copies as near_copies_of
from tallyweave.llm.common import bound_memory, shared_root
from tallyweave.llm.queries import RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_memory(spark)
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, model, carry=True).drop("_tw_kept")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_memory(spark)
    return line_dedup.dedup_texts(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_memory(spark)
    return near_copies_of.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_memory(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_memory(spark)
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep_ids=False)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("source_mixing", mixture), ("bpe", tokens)]

#: The first stage's model has no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs

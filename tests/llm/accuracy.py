"""``python -m tests.llm.accuracy FOLDER``: how operators 4 and 10 judge labelled rows, and operator 8 held-out texts, of a folder of tables."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import queries


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    labels = spark.read.parquet(f"{folder}/labels.parquet").dropDuplicates(["doc_id"])
    q = F.col("quality")
    rows = queries.op10_quality_classifier(spark, folder).where("held_out").join(labels, "doc_id")
    print("operator 10, held out:", rows.agg(F.count(q).alias("n"), F.count_if((q == 0) & (F.col("predicted") == 1)).alias("bad_passed"), F.count_if((q == 1) & (F.col("predicted") == 0)).alias("good_lost")).first().asDict())
    rows = queries.op4_quality_rules(spark, folder).join(labels, "doc_id")
    print("operator 4, all labelled:", rows.agg(F.count(q).alias("n"), F.count_if((q == 0) & F.col("kept")).alias("bad_kept"), F.count_if((q == 1) & ~F.col("kept") & ~F.col("base_failed")).alias("good_lost_beside_rules")).first().asDict())
    rows = queries.op8_lm_scoring(spark, folder).where("held_out")
    print("operator 8, held out, log10 a token:", rows.agg((F.sum("score") / F.sum("n_tokens")).alias("model"), (F.sum("base_score") / F.sum("n_tokens")).alias("counts")).first().asDict())


if __name__ == "__main__":
    main(sys.argv[1])

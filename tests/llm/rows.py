"""Small documents with every awkward case."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, fp long, size int, words string, block int, wrapper string"
LINE = "This very line is long enough to be counted, and many documents hold it."
ODD = [None, "", " ", "\n", "\n\n \t\n", "x", "Übermäßig ß É 日本 🙂", "a  b\tc\x0bd\x0ce\r\nf", "  lead and trail  ", "word " * 3, "nbsp and em \x1c\x85 end"]


def texts(n: int = 120, seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["th", "nd", "er", "ou", "é", "schen", "la", "A"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    out: list[str | None] = list(ODD)
    base = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(12)]
    for i in range(n):
        t = base[i % 12] if i % 3 == 0 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200)))
        if i % 4 == 0:
            t = t + "\n" + (LINE if i % 8 else "  " + LINE.upper() + "\t") + "\n" + t[:50]
        if i % 5 == 0:
            t += "\nrepeat me\nrepeat me\n" + "again and again and again and again"
        out.append(t)
    out.append("long " * 40_000 + "\n" + "z" * 100_000)
    return out


def documents(spark: SparkSession, repeat: bool = True) -> DataFrame:
    """Nulls in every column, repeated rows and ids, ties, and columns named like the operators' own."""
    rows = [(i, t, "en", ["src1", "src0", None, "ßrc"][i % 4] if i % 3 else "src0", len(t or ""), "b", 1, 2, "w", 3, "x") for i, t in enumerate(texts())]
    if repeat:
        rows += [rows[20], rows[20], (21, "another text under a used id\n" + LINE, None, None, None, None, None, None, None, None, None), (None, LINE, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)

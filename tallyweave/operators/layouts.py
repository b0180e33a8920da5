"""Text layouts to rows, driven by templates.

A template lists regex variants for a line (the first that matches gives the row), which of their groups make which columns,
columns that are carried down from earlier lines of the document, and columns taken from a line before or after.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count, number


#: Columns that hold whole numbers.
COUNTS = ("boxes", "size", "stems", "bunches", "pack")


@dataclass(frozen=True)
class Template:
    """variants: (regex, {column: group}); carried: {column: regex with one group}; looked: {column: (regex with one group, offset of lines)}."""

    name: str
    variants: tuple[tuple[str, dict[str, int]], ...]
    carried: dict[str, str] = field(default_factory=dict)
    looked: dict[str, tuple[str, int]] = field(default_factory=dict)
    numbers: tuple[str, ...] = ()
    normalise: tuple[tuple[str, str], ...] = ()


def parse(text_lines: DataFrame, template: Template) -> DataFrame:
    """Rows of all lines that a variant matches: doc_id, line_no, variant and the template's columns."""
    line = F.col("line")
    for pattern, by in template.normalise:
        line = F.regexp_replace(line, pattern, by)
    t = text_lines.withColumn("line", F.trim(line))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    above = order.rowsBetween(Window.unboundedPreceding, 0)
    got = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    for name, p in template.carried.items():
        t = t.withColumn(name, F.last(got(p), ignorenulls=True).over(above))
    for name, (p, offset) in template.looked.items():
        t = t.withColumn(name, F.lead(got(p), offset).over(order) if offset > 0 else F.lag(got(p), -offset).over(order))
    variant = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(i)) for i, (p, _) in enumerate(template.variants)])
    t = t.withColumn("variant", variant).where("variant is not null")
    names = list(dict.fromkeys(n for _, groups in template.variants for n in groups))
    for n in names:
        cases = [F.when(F.col("variant") == i, F.regexp_extract("line", p, groups[n])) for i, (p, groups) in enumerate(template.variants) if n in groups]
        value = F.coalesce(*cases)
        t = t.withColumn(n, (count(value) if n in COUNTS else number(value)).cast("double") if n in template.numbers else value)
    return t.select("doc_id", "line_no", "variant", *names, *template.carried, *template.looked)


def unpivot_sizes(rows: DataFrame, sizes: list[str]) -> DataFrame:
    """A grid with a column for each size becomes a row for each size that has a count."""
    keys = [c for c in rows.columns if c not in sizes]
    return rows.unpivot(keys, sizes, "size", "stems").where("stems > 0")


# Templates of common layouts; quantities in front, the description, then size, stems, price and total.
PLAIN = Template(
    "plain", ((r"^(\d+) (QB|HB) (.+?) (\d{2,3})CM ([\d.,]+) ([\d.,]+) ([\d.,]+)$", {"boxes": 1, "box_type": 2, "variety": 3, "size": 4, "stems": 5, "price": 6, "total": 7}),), numbers=("boxes", "size", "stems", "price", "total")
)
PARENT = Template(
    "parent and continuation",
    ((r"^(\d+) (QB|HB) (.+?) (\d{2,3})CM ([\d.,]+) ([\d.,]+) ([\d.,]+)$", {"variety": 3, "size": 4, "stems": 5, "price": 6, "total": 7}), (r"^([A-Z][A-Z ]+?) (\d{2,3})CM ([\d.,]+) ([\d.,]+) ([\d.,]+)$", {"variety": 1, "size": 2, "stems": 3, "price": 4, "total": 5})),
    carried={"box_type": r"^\d+ (QB|HB) "}, numbers=("size", "stems", "price", "total"),
)
LABEL_BELOW = Template("label on the next line", PLAIN.variants, looked={"label": (r"^LABEL: (.+)$", 1)}, numbers=PLAIN.numbers)
VARIETY_ABOVE = Template("variety on the line above", ((r"^(\d{2,3})CM ([\d.,]+) ([\d.,]+) ([\d.,]+)$", {"size": 1, "stems": 2, "price": 3, "total": 4}),), looked={"variety": (r"^([A-Z][A-Z ]+)$", -1)}, numbers=("size", "stems", "price", "total"))

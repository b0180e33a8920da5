"""A table of text layouts, and one plan that reads lines of any of them.

A layout is data: *shapes* of the lines that make rows, tried in order, what each sets besides, what is carried down from earlier lines
of the document, and what is taken from a line nearby. A shape is written as the line looks, token by token:

    <stems>      a field, by the kind of its name (``FIELDS``); more than one, or text around one, may make a token: <size>CM, $<price>
    #            a number that isn't kept        @   a word that isn't kept        ~   any text, or none
    ?token       a token that may be missing     _   no space, or some, within a token
    <numbers>    all numbers from here on; which is which follows from their arithmetic (``arithmetic``)

Tokens stand apart by white space; all else is taken literally, in either case. A shape that begins with ``!`` makes no row: it only feeds
what is carried, or keeps later shapes from reading the line.

A document whose layout gives no rows can be read by another one (``parse_with_fallback``), and a text may choose its layout by a marker that it holds (``chosen``).

The layouts are rows of a table (``table``), joined to the lines by their name; it has a row for each supplier's layout, so it's broadcast. Rows of
a document are completed from each other: stems from bunches and pack, price from total and stems, and so on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import count, number, translate_colors
from . import segments
from .arithmetic import ROLES, with_reading

_TEXT = r"[A-Za-zÀ-ÿ\uFFFD][\wÀ-ÿ\uFFFD .,'&/+!()*°-]*?"
_AMOUNT = r"[\d.,]+"
FIELDS = {
    "boxes": r"\d+", "box_type": r"HB|QB|FB|EB|TB|HF|QF|HALF|QUARTER|FULL|HAL|QUA|[HQFET]B?", "species": r"[A-Za-z]+", "variety": _TEXT,
    "color": _TEXT, "farm": _TEXT, "grade": r"[A-Za-z]+", "label": r"[\wÀ-ÿ-]+", "size": r"\d{2,3}", "pack": r"\d+", "per_box": _AMOUNT,
    "bunches": _AMOUNT, "stems": _AMOUNT, "price": _AMOUNT, "price_bunch": _AMOUNT, "total": _AMOUNT, "weight": r"\d+", "numbers": r"[\d$][\d.,$\s]*",
}
COUNTS = ("boxes", "size", "pack", "per_box", "bunches", "stems", "weight")
AMOUNTS = ("price", "price_bunch", "total")
_TOKEN = re.compile(r"<(\w+)>|(#)|(@)|(_)|(\$)|([^<#@_$]+)")

# Box types as they are written and as they are kept; kinds of flowers by the beginning of their name.
BOX_TYPES = {"H": "HB", "Q": "QB", "F": "FB", "E": "EB", "T": "TB", "HALF": "HB", "QUARTER": "QB", "FULL": "FB", "HF": "HB", "QF": "QB", "HAL": "HB", "QUA": "QB"}
SPECIES = {"ROS": "ROSES", "GARDEN": "ROSES", "CAR": "CARNATIONS", "CLAVEL": "CARNATIONS", "MINI": "CARNATIONS", "HYD": "HYDRANGEAS", "ALSTR": "ALSTROEMERIA", "GYPS": "GYPSOPHILA", "CHRYS": "CHRYSANTHEMUM", "POM": "CHRYSANTHEMUM"}
#: The farthest line, above or below, that a layout may look at.
LOOK = 5
MIXED = r"^(?:MIX|MIXED|MIXTO|ASSORTED|SURTIDO|ABC)\b|\b(?:MIX|MIXED BOX|ASSORTED)$"


@dataclass(frozen=True)
class Layout:
    """shapes: a shape, or a shape and what its rows are set to. fixed: what all rows are set to where the line doesn't say. look: {field: (shape of one field, lines from here)}.

    eu: a comma is always the decimal mark and dots separate thousands. clean: (pattern, replacement) for each line before it's read.
    What a shape sets may be a field or: prefix (words put before the variety), part (``parent`` or ``child``: see ``segments``), mixed (``true``: the
    parent's children count instead of it), keeps (``true``: such a parent counts if it has none).
    pack_first: <numbers> usually hold the pack before the bunches. drop: words that may stand before a variety without being part of it.
    color_last: a colour before the variety is translated and put behind it. sums: <numbers> may be bunches, pack and price alone.
    """

    name: str
    shapes: tuple = ()
    carry: tuple[str, ...] = ()
    fixed: dict = field(default_factory=dict)
    look: dict[str, tuple[str, int]] = field(default_factory=dict)
    eu: bool = False
    translate: bool = False
    clean: tuple[tuple[str, str], ...] = ()
    active: bool = True
    pack_first: bool = False
    drop: tuple[str, ...] = ()
    color_last: bool = False
    sums: bool = False


def compiled(shape: str) -> tuple[str, list[str], bool]:
    """A shape's regular expression, the fields of its groups, and whether it makes rows."""
    emits = not shape.startswith("!")
    out, fields, begun = "(?i)^\\s*", [], False
    for token in shape.lstrip("! ").split():
        optional = token == "~" or (token[0] == "?" and len(token) > 1)
        if token == "~":
            piece = ".+?"
        else:
            piece = ""
            for name, digits, word, glue, dollar, literal in _TOKEN.findall(token[1:] if optional else token):
                if name:
                    fields.append(name)
                    piece += f"({FIELDS[name]})"
                else:
                    piece += r"[\d.,]+" if digits else r"\S+" if word else r"\s*" if glue else r"\$\s*" if dollar else re.escape(literal)
        if not begun:
            out += (f"(?:{piece}\\s+)??" if token == "~" else f"(?:{piece}\\s+)?") if optional else piece
            begun = not optional
        else:
            out += f"(?:\\s+{piece})?" if optional else f"\\s+{piece}"
    return out + "\\s*$", fields, emits


_SCHEMA = (
    "fmt string, shapes array<struct<pattern: string, fields: array<string>, emits: boolean, own: map<string, string>, fixed: map<string, string>>>, carry array<string>, "
    "look array<struct<field: string, pattern: string, at: int>>, eu boolean, translate boolean, clean array<struct<pattern: string, by: string>>, active boolean, pack_first boolean, drop array<string>, color_last boolean, sums boolean"
)


def table(spark: SparkSession, layouts: list[Layout]) -> DataFrame:
    """The layouts as a table: it can be stored, edited, and switched off row by row."""
    rows = []
    for x in layouts:
        shapes = []
        for s in x.shapes:
            shape, own = (s, {}) if isinstance(s, str) else s
            shapes.append((*compiled(shape), {k: str(v) for k, v in own.items()}, {k: str(v) for k, v in (x.fixed | own).items()}))
        rows.append((x.name, shapes, list(x.carry), [(k, compiled(s)[0], at) for k, (s, at) in x.look.items()], x.eu, x.translate, list(x.clean), x.active, x.pack_first, list(x.drop), x.color_last, x.sums))
    return spark.createDataFrame(rows, _SCHEMA)


def activate(registry: DataFrame, names: list[str], on: bool = True) -> DataFrame:
    """The table with some layouts switched on or off."""
    return registry.withColumn("active", F.when(F.col("fmt").isin(names), F.lit(on)).otherwise(F.col("active")))


_MARK = "\x01"


def _cleaned(layouts: list) -> Column:
    """The line as its layout cleans it. Patterns are literals: each is compiled once, not once a line."""
    out = F.trim("line")
    branches = F
    for row in layouts:
        line = F.trim("line")
        for step in row["clean"]:
            line = F.regexp_replace(line, step["pattern"], step["by"])
        if row["clean"]:
            branches = branches.when(F.col("fmt") == row["fmt"], line)
    return branches.otherwise(out) if branches is not F else out


def _found(layouts: list) -> Column:
    """The number of the first shape that fits the line, and what its groups hold, in one string; null if none fits."""
    branches = F
    for row in layouts:
        shapes = F
        for i, s in enumerate(row["shapes"]):
            said = "".join(f"{_MARK}${k + 1}" for k in range(len(s["fields"])))
            shapes = shapes.when(F.col("line").rlike(s["pattern"]), F.regexp_replace("line", s["pattern"], f"{i}{said}"))
        if row["shapes"]:
            branches = branches.when(F.col("fmt") == row["fmt"], shapes)
    return branches if branches is not F else F.lit(None).cast("string")


def parse(text_lines: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of all lines that a shape of their layout fits. The active layouts, a row a supplier, pass through the driver.

    ``text_lines``: doc_id, fmt, line_no, line; a document has one layout. Lines of unknown or inactive layouts give no rows.
    """
    layouts = registry.where("active").select("fmt", "shapes", "clean").collect()
    t = text_lines.join(registry.where("active").drop("clean"), "fmt")
    t = t.withColumn("line", _cleaned(layouts)).withColumn("_found", _found(layouts))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    places = range(-LOOK, LOOK + 1)
    around = F.array(*[F.coalesce(F.lag("line", -k).over(order) if k < 0 else F.lead("line", k).over(order), F.lit("")) if k else F.col("line") for k in places])
    t = t.withColumn("around", around)
    t = t.withColumn("_found", F.split("_found", _MARK)).withColumn("shape", F.get("shapes", F.col("_found")[0].cast("int")))
    t = t.withColumn("got", F.expr("map_from_arrays(shape.fields, slice(_found, 2, size(shape.fields)))"))
    seen = F.expr("map_from_arrays(transform(look, l -> l.field), transform(look, l -> if(get(around, l.at + LOOK) rlike l.pattern, regexp_extract(get(around, l.at + LOOK), l.pattern, 1), '')))".replace("LOOK", str(LOOK)))
    t = t.withColumn("seen", seen)
    names = [n for n in FIELDS]
    said = {n: F.coalesce(F.nullif(F.trim(F.try_element_at("got", F.lit(n))), F.lit("")), F.nullif(F.trim(F.try_element_at("seen", F.lit(n))), F.lit(""))) for n in names}
    t = t.select("doc_id", "fmt", "line_no", "line", "carry", "eu", "translate", "pack_first", "drop", "color_last", "sums", "shape", *[v.alias(n) for n, v in said.items()])
    above = order.rowsBetween(Window.unboundedPreceding, 0)
    # what a line of any shape says holds for the rows below it
    carried = {n: F.when(F.array_contains("carry", n), F.last(F.when(F.col("shape").isNotNull(), F.col(n)), ignorenulls=True).over(above)).otherwise(F.col(n)) for n in ("box_type", "label", "farm", "variety", "size", "pack", "price", "boxes")}
    t = t.withColumns(carried).where("shape is not null and shape.emits")
    fixed = lambda n: F.try_element_at("shape.fixed", F.lit(n))
    mixed = F.coalesce(fixed("mixed") == "true", F.coalesce("variety", fixed("variety")).rlike(f"(?i){MIXED}"), F.lit(False))
    # a parent's pack holds for its children, printed or not
    packs = F.when(fixed("part") == "parent", F.floor(F.try_divide(count(F.col("stems")), count(F.col("bunches")))).cast("string"))
    # what a shape sets comes before what is inherited, and that before what its layout sets
    t = t.withColumns({n: F.coalesce(F.col(n), F.try_element_at("shape.own", F.lit(n))) for n in names})
    t = t.withColumns({"part": fixed("part"), "mixed": mixed, "keeps": fixed("keeps") == "true", "prefix": fixed("prefix"), "pack": F.coalesce("pack", packs)})
    t = segments.resolve(t, ["price", "pack", "box_type", "size", "species", "grade", "label"], "keeps")
    t = t.withColumns({n: F.coalesce(F.col(n), fixed(n)) for n in names})
    return completed(t)


def parse_with_fallback(text_lines: DataFrame, registry: DataFrame, other: dict[str, str]) -> DataFrame:
    """As ``parse``; documents that give no rows are read once more by the layout that ``other`` names for theirs.

    A document is read either way whole: its rows come from one layout, whose name is their fmt.
    """
    first = parse(text_lines, registry)
    names = F.create_map(*[F.lit(x) for pair in other.items() for x in pair])
    again = text_lines.withColumn("fmt", F.try_element_at(names, F.col("fmt"))).where("fmt is not null")
    return first.unionByName(parse(again.join(first.select("doc_id").distinct(), "doc_id", "left_anti"), registry))


def chosen(texts: DataFrame, markers: list[tuple[str, str, str]]) -> DataFrame:
    """Texts whose layout has several editions: the first of (fmt, pattern, edition) whose pattern the text holds anywhere; else fmt stays.

    ``texts``: doc_id, fmt, text.
    """
    edition = [F.when((F.col("fmt") == fmt) & F.col("text").rlike(pattern), name) for fmt, pattern, name in markers]
    return texts.withColumn("fmt", F.coalesce(*edition, F.col("fmt")))


def completed(t: DataFrame) -> DataFrame:
    number_of = lambda n: F.when(F.col("eu"), F.translate(F.regexp_replace(n, r"[.\s]", ""), ",", ".").try_cast("decimal(18,5)")).otherwise(number(F.col(n)))
    t = t.withColumns({n: count(F.col(n)) for n in COUNTS} | {n: number_of(n).cast("double") for n in AMOUNTS})
    t = with_reading(t).where("numbers is null or reading is not null")
    t = t.withColumns({r: F.coalesce(F.col(r), F.col(f"reading.{r}").cast("int" if r in COUNTS else "double")) for r in ROLES})
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    t = t.withColumn("bunches", F.coalesce("bunches", F.col("boxes") * F.col("per_box")))
    t = t.withColumn("pack", F.coalesce("pack", F.when(F.col("stems") % F.col("bunches") == 0, (F.col("stems") / F.col("bunches")).cast("int")), F.lit(25)))
    t = t.withColumn("stems", F.coalesce("stems", F.col("bunches") * F.col("pack")))
    t = t.withColumn("bunches", F.coalesce("bunches", F.floor(ratio("stems", "pack")).cast("int")))
    t = t.withColumn("price", F.coalesce("price", ratio("price_bunch", "pack"), ratio("total", "stems")))
    t = t.withColumn("total", F.coalesce("total", F.col("stems") * F.col("price")))
    look_up = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    kind = F.coalesce(*[F.when(F.upper("species").startswith(k), v) for k, v in SPECIES.items()], F.upper("species"))
    words = F.split(F.trim(F.regexp_replace(F.upper(F.coalesce("variety", "color")), r"\s+", " ")), " ")
    # the words from the first on that isn't to be dropped
    begins = F.expr("array_position(transform(_words, w -> array_contains(drop, w)), false)")
    t = t.withColumn("_words", words).withColumn("_begins", begins)
    name = F.array_join(F.when(F.col("_begins") > 0, F.slice("_words", F.col("_begins").cast("int"), F.size("_words"))).otherwise(F.col("_words")), " ")
    first = translate_colors(F.regexp_extract(name, r"^(\S+)", 1))
    turned = F.col("color_last") & (first != F.regexp_extract(name, r"^(\S+)", 1))
    name = F.when(turned, F.trim(F.concat_ws(" ", F.regexp_replace(name, r"^\S+\s*", ""), first))).otherwise(name)
    name = F.when(F.col("prefix").isNull() | name.startswith(F.col("prefix")), name).otherwise(F.concat_ws(" ", "prefix", name))
    return t.select(
        "doc_id", "fmt", "line_no", kind.alias("species"), F.when(F.col("translate"), translate_colors(name)).otherwise(name).alias("variety"), F.coalesce(F.upper("grade"), F.lit("")).alias("grade"),
        F.coalesce("size", F.lit(0)).alias("size"), "pack", "bunches", "stems", F.round("price", 5).alias("price"), F.round("total", 2).alias("total"),
        F.coalesce(look_up(BOX_TYPES, F.upper("box_type")), F.upper("box_type"), F.lit("")).alias("box_type"), F.upper(F.coalesce("label", "farm", F.lit(""))).alias("label"),
        F.when(F.coalesce(name, F.lit("")).rlike(MIXED), "mixed_box").otherwise("pending").alias("status"),
    )


def by_layout(texts: DataFrame, detected: DataFrame) -> DataFrame:
    """Lines of texts whose layout is known: doc_id, fmt, line_no, line. ``detected``: doc_id, fmt."""
    return texts.join(detected, "doc_id").select("doc_id", "fmt", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))

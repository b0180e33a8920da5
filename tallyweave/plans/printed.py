"""Lines of invoices as suppliers print them, made from the given tables: an order is a document, and its number says whose layout it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import tables

#: The layout of orders by their number's remainder.
LAYOUTS = ("mystic", "brissas", "colibri", "verdesestacion", "uma", "timana", "meaflos", "golden", "alegria", "auto_milagro", "auto_elite")


def rows(spark: SparkSession, d: str) -> DataFrame:
    """What the lines say: doc_id, line_no, fmt, name, size, pack, bunches, stems, cents (the price of a stem), boxes, key."""
    c = F.col
    t = tables.table(spark, d, "lineitem").join(tables.table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    pack = F.element_at(F.array(F.lit(10), F.lit(20), F.lit(25)), (c("l_partkey") % 3 + 1).cast("int"))
    bunches = (1 + c("l_quantity") % 12).cast("int")
    fmt = F.element_at(F.array(*map(F.lit, LAYOUTS)), (c("l_orderkey") % len(LAYOUTS) + 1).cast("int"))
    t = t.select(
        c("l_orderkey").alias("doc_id"), (F.row_number().over(order) - 1).alias("line_no"), fmt.alias("fmt"), c("p_name").alias("name"), c("l_partkey").alias("key"),
        (40 + 10 * (c("l_partkey") % 5)).cast("int").alias("size"), pack.alias("own_pack"), bunches.alias("bunches"), (20 + c("l_partkey") % 40).cast("int").alias("cents"),
    )
    usual = F.when(c("fmt").isin("brissas", "meaflos", "alegria"), 25).when(c("fmt").isin("colibri", "golden"), 20).otherwise(c("own_pack"))
    t = t.withColumn("pack", usual).withColumn("boxes", F.when((c("fmt") == "timana") & (c("line_no") % 2 == 0), 2).otherwise(1))
    return t.withColumn("stems", c("bunches") * c("pack") * c("boxes")).drop("own_pack")


def decimal(units: Column, places: int, mark: str = ".", thousands: str = "") -> Column:
    """A whole number of hundredths or thousandths as an amount."""
    whole = F.floor(units / 10**places).cast("string")
    if thousands:
        whole = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", thousands)
    return F.concat(whole, F.lit(mark), F.lpad((units % 10**places).cast("string"), places, "0"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, fmt, line_no, line."""
    c = F.col
    t, total = rows(spark, d), c("stems") * c("cents")
    milli, price3, upper = total * 10, c("cents") * 10, F.upper("name")
    us3, eu3, eu2 = [decimal(x, 3) for x in (price3, milli)], [decimal(x, 3, ",") for x in (price3, milli)], [decimal(c("cents"), 2, ","), decimal(total, 2, ",", ".")]
    us2 = [decimal(c("cents"), 2), decimal(total, 2)]
    broken = F.regexp_replace(decimal(total, 2, ","), r"^(\d)(?=\d)", "$1 ")
    blanks = F.repeat(F.lit(" "), (F.floor((c("size") - 30) / 10) + 1).cast("int"))
    mixed = c("doc_id") % 2 == 0
    text = {
        "mystic": F.format_string("%d H R%d %s %d %d %d %d %s %s", "boxes", c("key") % 40 + 10, upper, "bunches", "pack", "size", "stems", *eu3),
        "brissas": F.when(c("line_no") == 0, F.format_string("%d - %d LA FARM %d HB ROSE %s %d %d %d %s %s Standing LA FARM", c("line_no") + 1, c("line_no") + 1, "boxes", upper, "size", "stems", "stems", *us3))
        .otherwise(F.format_string("ROSE %s %d %d %d %s %s Venta diaria THE 2 FARMS", upper, "size", "stems", "stems", *us3)),
        "colibri": F.when(c("key") % 2 == 0, F.format_string("%d H Carnation %s X %d - FAN %d SEL GARCIA CO-0603129000 %d %d ST %s %s", "boxes", F.initcap("name"), "pack", c("key") % 900000 + 100000, "stems", "stems", *us3))
        .otherwise(F.format_string("%d H Carnation Carn Mix Red/White %d- FAN R45 CO-0603129000 %d %d ST %s %s", "boxes", c("key") % 900000 + 100000, "stems", "stems", *us3)),
        "verdesestacion": F.format_string("%d / 60 0,50 1,00 %s - MARL %d %d VERALEZA SLU FRESH CUT ROSES*%d CO 0603110000 $ %s $ %s", c("line_no") + 1, F.initcap("name"), "size", "stems", "pack", *eu2),
        "uma": F.format_string("%d %d hb 350 %s %d cm Cuzco Carlos / Zc %d %d %d $ %s $ %s", c("key") + 1000, "boxes", F.initcap("name"), "size", "stems", "pack", "bunches", F.replace(eu2[0], F.lit(","), F.lit(" ,")), broken),
        "timana": F.when(c("boxes") == 2, F.format_string("ROSE %s %dCM OF CO-FREE0603110050 %d HB %d %d %d %s $ %s", upper, "size", "boxes", "bunches", "pack", "stems", *us3))
        .otherwise(F.format_string("ROSE %s %dCM %d %d %s", upper, "size", "bunches", "pack", us3[0])),
        "meaflos": F.format_string("Rosas - %s %dcm 0,00 0,00 %s %s %s", F.initcap("name"), "size", F.regexp_replace(c("stems").cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", "."), *eu2),
        "golden": F.format_string("%d H 500 %d CONSUMER BUNCH CARNATION FANCY %s CB S2 %s %s", "boxes", "stems", F.when(c("key") % 3 == 0, "R43- MIX WH RD").when(c("key") % 3 == 1, "PUERTO FCY WH").otherwise("FCY PINK"), *us2),
        "alegria": F.concat(F.format_string("%d QB %s %d X .00", "boxes", upper, "pack"), blanks, c("bunches").cast("string"), F.lit("      "), F.format_string("%d %s %s", "stems", *us2)),
        "auto_milagro": F.when((c("line_no") == 0) & mixed, F.format_string("%d H ROSES %s X %d - %d (Mixto) 12 300", "boxes", upper, "pack", "size"))
        .when(c("line_no") == 0, F.format_string("%d H ROSES %s X %d - %d 000001 0603110060 %d 1 %d %s %s", "boxes", upper, "pack", "size", "bunches", "stems", *us2))
        .otherwise(F.format_string("ROSES %s X %d - %d Milagro %d %d %s", upper, "pack", "size", "bunches", "stems", us2[0])),
        "auto_elite": F.when((c("line_no") == 0) & mixed, F.format_string("ALSTROEMERIA ASSORTED SELECT 1HALF 12 %d %d %s 0.00 %s 0", "stems", "bunches", us2[0], us2[1]))
        .when(c("line_no") == 0, F.format_string("ALSTROEMERIA %s SELECT 1HALF 12 %d %d %s 0.00 %s 0", upper, "stems", "bunches", us2[0], us2[1]))
        .otherwise(F.format_string("ALSTROEMERIA %s SELECT %d", upper, "stems")),
    }
    line = F.coalesce(*[F.when(c("fmt") == n, x) for n, x in text.items()])
    return t.select("doc_id", "fmt", "line_no", line.alias("line"))


_FMT = "[" + ", ".join(f"'{n}'" for n in LAYOUTS) + f"][doc_id % {len(LAYOUTS)} + 1]"

#: The rows that the documents should give, from the tables alone.
SQL = f"""
WITH ordered AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS line_no,
  l_partkey AS key, p_name AS name, (1 + l_quantity % 12)::INT AS b, 20 + l_partkey % 40 AS cents, (40 + 10 * (l_partkey % 5))::INT AS cm FROM lineitem JOIN part ON l_partkey = p_partkey),
lay AS (SELECT *, {_FMT} AS fmt FROM ordered),
said AS (SELECT *, (CASE WHEN fmt IN ('brissas', 'meaflos', 'alegria') THEN 25 WHEN fmt IN ('colibri', 'golden') THEN 20 ELSE [10, 20, 25][key % 3 + 1] END)::INT AS own,
  CASE WHEN fmt = 'timana' AND line_no % 2 = 0 THEN 2 ELSE 1 END AS boxes FROM lay),
counted AS (SELECT *, b * own * boxes AS n FROM said),
boxed AS (SELECT *, first_value(own) OVER w AS box_pack, first_value(cents) OVER w AS box_cents FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
kept AS (SELECT *, doc_id % 2 = 0 AS mixed FROM boxed WHERE fmt NOT IN ('auto_milagro', 'auto_elite') OR (line_no = 0) <> (doc_id % 2 = 0)),
priced AS (SELECT *, CASE WHEN fmt = 'auto_elite' THEN box_pack ELSE own END AS pk, CASE WHEN fmt = 'auto_elite' THEN box_cents ELSE cents END AS pc FROM kept)
SELECT doc_id, fmt, line_no::INT AS line_no,
  CASE WHEN fmt IN ('colibri', 'golden') THEN 'CARNATIONS' WHEN fmt = 'auto_elite' THEN 'ALSTROEMERIA' ELSE 'ROSES' END AS species,
  CASE WHEN fmt = 'colibri' AND key % 2 = 1 THEN 'MIX' WHEN fmt = 'golden' THEN ['MIXTO', 'BLANCO', 'ROSA'][key % 3 + 1] ELSE upper(name) END AS variety,
  CASE WHEN fmt IN ('colibri', 'golden') THEN 'FANCY' WHEN fmt = 'auto_elite' THEN 'SELECT' ELSE '' END AS grade,
  CASE fmt WHEN 'colibri' THEN 0 WHEN 'golden' THEN 70 WHEN 'auto_elite' THEN 70 ELSE cm END::INT AS size, pk::INT AS pack, (n // pk)::INT AS bunches, n::INT AS stems,
  pc / 100.0 AS price, (n * pc) / 100.0 AS total,
  CASE WHEN fmt = 'alegria' THEN 'QB' WHEN fmt IN ('verdesestacion', 'meaflos') THEN '' ELSE 'HB' END AS box_type,
  CASE fmt WHEN 'mystic' THEN 'R' || (key % 40 + 10) WHEN 'verdesestacion' THEN 'MARL' WHEN 'uma' THEN 'CUZCO CARLOS / ZC' WHEN 'golden' THEN ['R43', 'PUERTO', ''][key % 3 + 1] ELSE '' END AS label
FROM priced"""

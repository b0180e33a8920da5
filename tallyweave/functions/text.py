"""Text as columns: keys, numbers, translations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour words of invoices and of the catalogue.
COLORS = {
    "WHITE": "BLANCO", "BLANCA": "BLANCO", "RED": "ROJO", "ROJA": "ROJO", "PINK": "ROSA", "ROSE": "ROSA", "YELLOW": "AMARILLO", "AMARILLA": "AMARILLO",
    "MIX": "MIXTO", "MIXED": "MIXTO", "ASSORTED": "MIXTO", "ORANGE": "NARANJA", "PURPLE": "MORADO", "VIOLET": "VIOLETA", "LILAC": "LILA", "PEACH": "MELOCOTON",
    "SALMON": "SALMON", "GREEN": "VERDE", "NOVELTY": "NOVEDADES", "NOVELTIES": "NOVEDADES", "BICOLOR": "BICOLOR", "DARK": "OSCURO", "LIGHT": "CLARO",
    "BURGUNDY": "GRANATE", "BORDEAUX": "GRANATE", "WINE": "GRANATE", "CREAM": "CREMA", "BRONZE": "BRONCE", "BLUE": "AZUL", "HOT": "FUCSIA", "FUCHSIA": "FUCSIA", "MAGENTA": "FUCSIA",
}
# Patterns of a printed invoice total, most specific first.
TOTAL_PATTERNS = (
    r"TOTAL\s+FOB\s+\d+\s+[\d.,]+\s+([\d.,]+)",
    r"Vlr\.?\s*Total\s+FCA[^:]*:\s*([\d.,]+)",
    r"Total\s+Value\s*\$?\s*([\d.,]+)",
    r"TOTAL\s+DUE\s+USD?\s*\$?\s*([\d.,]+)",
    r"Total\s+Invoice\s+USD?\s*\$?\s*([\d.,]+)",
    r"Amount\s+Due\s*[:\s]*\$\s*([\d.,]+)",
    r"INVOICE\s+TOTAL\s*\(?[^)]*\)?\s*([\d.,]+)",
    r"TOTAL\s+A\s+PAGAR\s*\$?\s*([\d.,]+)",
    r"Invoice\s+Amount\s*\$?\s*([\d.,]+)",
    r"TOTALS?\s+\d+\s+\$\s*USD?\s+([\d.,]+)",
    r"(?:Inv\.?\s+Subtotal|Sub\s*Total)\s*\$?\s*([\d.,]+)",
    r"GRAND\s+TOTAL\s*[:\s]*\$?\s*([\d.,]+)",
    r"Total\s+USD?\s*\$?\s*([\d.,]+)",
)


def canonical(variety: Column) -> Column:
    """Upper case, anything but letters and digits as one space; the same for all spellings of a variety."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(variety), "[^A-Z0-9 ]+", " "), " +", " "))


def match_key(species: Column, variety: Column, size: Column, pack: Column, grade: Column) -> Column:
    return F.concat_ws("|", species, canonical(variety), size.cast("string"), pack.cast("string"), F.upper(grade))


def translate_colors(text: Column) -> Column:
    """The whole text if it is a colour, else word by word."""
    table = F.create_map(*[F.lit(x) for pair in COLORS.items() for x in pair])
    name = F.upper(F.trim(text))
    words = F.transform(F.split(name, " +"), lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.coalesce(F.try_element_at(table, name), F.array_join(words, " "))


def number(text: Column) -> Column:
    """Amounts in US or European notation as decimals of five places; null if it isn't one.

    Of a dot and a comma the later one is the decimal mark. A comma alone is one too, unless three digits follow the last: then commas
    separate thousands. A dot alone is a decimal mark, however many digits follow: prices a stem have three.
    """
    t = F.regexp_replace(text, r"[\s$]", "")
    dot, comma = F.length(t) - F.instr(F.reverse(t), "."), F.length(t) - F.instr(F.reverse(t), ",")
    dots, commas = F.length(t) - F.length(F.replace(t, F.lit("."))), F.length(t) - F.length(F.replace(t, F.lit(",")))
    us, eu = F.replace(t, F.lit(",")), F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit("."))
    both = (dots > 0) & (commas > 0)
    plain = F.when(both & (dot > comma), us).when(both, eu).when(t.rlike(r",[0-9]{3}$"), us).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return F.when(plain.rlike(r"^-?(?:[0-9]+(\.[0-9]*)?|\.[0-9]+)$"), plain.try_cast("decimal(18,5)"))


def count(text: Column) -> Column:
    """Whole numbers, with or without separators of thousands; a decimal part of zeros doesn't count."""
    return F.regexp_replace(F.regexp_replace(text, r"[.,]0{1,2}$", ""), "[^0-9]", "").try_cast("int")


def printed_total(text: Column) -> Column:
    """The first pattern whose amount is positive; 0 if there is none."""
    zero = F.lit(0).cast("decimal(18,5)")
    found = F.transform(F.array(*[F.regexp_extract(text, f"(?i){p}", 1) for p in TOTAL_PATTERNS]), number)
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: x > 0), F.lit(1)), zero)


def fold(text: Column) -> Column:
    """Upper case without accents, spaces squeezed."""
    return F.trim(F.regexp_replace(F.translate(F.upper(text), "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "AAAAAEEEEIIIIOOOOOUUUUNC"), r"\s+", " "))


def expected_name(species: Column, variety: Column, size: Column, pack: Column, grade: Column, origin: Column) -> Column:
    """The catalogue name that a line should have, by species."""
    v, g = F.upper(variety), F.upper(grade)
    measured = (size > 0) & (pack > 0)
    tail = F.format_string(" %dCM %dU", size, pack)
    color = translate_colors(v)
    carnation = F.concat_ws(
        " ", F.when(pack == 10, F.lit("MINI CLAVEL COL")).otherwise(F.lit("CLAVEL COL")), F.nullif(g, F.lit("")), color, F.format_string("%dCM %dU", F.when(size > 0, size).otherwise(70), pack)
    )
    return (
        F.when(species == "ROSES", F.concat(F.lit("ROSA "), F.when(origin == "EC", F.lit("EC ")).otherwise(F.lit("COL ")), v, F.when(measured, tail).otherwise(F.lit(""))))
        .when(species == "CARNATIONS", carnation)
        .when(species == "HYDRANGEAS", F.concat(F.lit("HYDRANGEA "), v, F.when(measured, tail).otherwise(F.lit(""))))
        .when(species == "ALSTROEMERIA", F.when(size > 0, F.concat(F.concat_ws(" ", F.lit("ALSTROMERIA"), F.when(origin == "COL", F.lit("COL")).otherwise(F.lit("EC")), F.nullif(g, F.lit("")), v), tail)).otherwise(F.concat(F.lit("ALSTROMERIA "), F.when(origin == "COL", F.lit("COL ")).otherwise(F.lit("EC ")), v)))
        .when(species == "GYPSOPHILA", F.concat(F.lit("PANICULATA "), v))
        .when(species == "CHRYSANTHEMUM", F.concat(F.lit("CRISANTEMO "), v, F.when(size > 0, tail).otherwise(F.lit(""))))
        .otherwise(v)
    )

"""Validation rules and review lanes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_TOLERANCE, HEADER_TOLERANCE = 0.02, 0.01
# Trust of a learned link by its status.
TRUST = {"manual_confirmado": 0.98, "aprendido_confirmado": 0.85, "aprendido_en_prueba": 0.55, "ambiguo": 0.30, "rechazado": 0.0}


def relative_difference(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.abs(a)).otherwise(F.abs(a - b) / F.abs(b))


def line_errors() -> Column:
    """Codes of what is wrong with a line; empty if nothing is."""
    c = F.col
    mismatch = (c("stems") > 0) & (c("bunches") > 0) & (c("pack") > 0) & (c("bunches") * c("pack") != c("stems"))
    expected = c("stems") * c("price_per_stem")
    total = (c("stems") > 0) & (c("price_per_stem") > 0) & (c("line_total") > 0) & (relative_difference(c("line_total"), expected) > LINE_TOLERANCE)
    zero = (c("match_status") == "ok") & (c("line_total") <= 0)
    codes = F.array(F.when(mismatch, F.lit("stems_mismatch")), F.when(total, F.lit("total_mismatch")), F.when(zero, F.lit("line_total_zero")))
    return F.filter(codes, lambda x: x.isNotNull())


def review_lane(errors: Column) -> Column:
    """auto, quick or full."""
    c = F.col
    full = (
        c("match_status").isin("sin_match", "sin_parser", "llm_extraido")
        | (c("extraction_source") == "rescue")
        | (c("extraction_confidence") < 0.50)
        | ((c("match_status") == "ambiguous_match") & (c("link_confidence") < 0.50))
    )
    capped = lambda x: F.when(F.size(errors) > 0, F.least(x, F.lit(0.70))).otherwise(x)
    auto = (
        (c("match_status") == "ok") & (capped(c("link_confidence")) >= 0.80) & (capped(c("match_confidence")) >= 0.80)
        & (c("candidate_margin") >= 0.05) & (F.size(errors) == 0) & (c("extraction_confidence") >= 0.80)
    )
    return F.when(full, "full").when(auto, "auto").otherwise("quick")


def needs_review(errors: Column, threshold: float, fuzzy: bool) -> Column:
    """What a person should look at; ``fuzzy``: links found by likeness alone count too."""
    c = F.col
    bad = c("match_status").isin("ambiguous_match", "sin_match", "sin_parser") | (F.size(errors) > 0) | ((c("match_status") == "ok") & (c("match_confidence") < threshold))
    return bad | (c("match_method").startswith("fuzzy")) if fuzzy else bad


def trust(status: Column, confirmed: Column, corrected: Column) -> Column:
    """Reliability of a learned link, 0 to 1."""
    table = F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair])
    base = F.coalesce(F.try_element_at(table, status), F.lit(0.40))
    lowered = F.greatest(F.lit(0.10), base - 0.15 * corrected)
    raised = F.least(F.lit(TRUST["manual_confirmado"]), base + 0.05 * F.least(confirmed - 1, F.lit(5)))
    return F.round(F.when(corrected > 0, lowered).when(confirmed > 1, raised).otherwise(base), 3)


def verdict() -> Column:
    c = F.col
    return (
        F.when(c("samples") == 0, "SIN_MUESTRAS").when(c("detected") < c("samples"), "NO_DETECTADO").when(c("parsed_any") < c("samples"), "NO_PARSEA")
        .when((c("totals_ok") < c("samples") * 0.6) & (c("samples") > 1), "TOTALES_MAL").when(c("total_rescued") > c("total_parsed"), "MUCHO_RESCATE").otherwise("OK")
    )

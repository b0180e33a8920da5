from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import checks, text


@pytest.mark.parametrize(
    ("written", "value"),
    [("1,234.56", "1234.56"), ("1.234,56", "1234.56"), ("1234,5", "1234.50"), ("1.234", "1.234"), ("0.350", "0.35"), ("1,234", "1234.00"), ("12.5", "12.50"), ("1.234.567", None), ("1,234,567", "1234567"), ("$ 7.00", "7.00"), ("1 234,00", "1234.00"), ("", None), ("abc", None), (None, None), ("-3.5", "-3.50"), ("0", "0.00")],
)
def test_number(spark, written, value):
    got = spark.createDataFrame([(written,)], "t string").select(text.number(F.col("t"))).first()[0]
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize(
    ("printed", "value"),
    [("GRAND TOTAL: $ 1,234.50", 1234.5), ("Total Value $ 88.00", 88), ("TOTAL FOB 12 34.5 99.10\nGRAND TOTAL 5", 99.1), ("Amount Due: $ 12.00", 12), ("TOTAL A PAGAR 1.234,00", 1234), ("Sub Total 0.00\nTotal USD 10.00", 10), ("nothing 12.00", 0), ("", 0)],
)
def test_printed_total(spark, printed, value):
    assert float(spark.createDataFrame([(printed,)], "t string").select(text.printed_total(F.col("t"))).first()[0]) == value


def test_keys_and_folding(spark):
    df = spark.createDataFrame([("Mandarin. X-Pression", " ébano  ñu "), ("mandarin x pression", "EBANO NU"), ("MANDARIN X--PRESSION", "Ébano Ñu")], "v string, t string")
    assert df.select(text.canonical(F.col("v"))).distinct().collect() == [("MANDARIN X PRESSION",)]
    assert df.select(text.fold(F.col("t"))).distinct().collect() == [("EBANO NU",)]


def test_colors(spark):
    df = spark.createDataFrame([("White",), ("dark pink rose",), ("unknown",), ("",)], "v string")
    assert [r[0] for r in df.select(text.translate_colors(F.col("v"))).collect()] == ["BLANCO", "OSCURO ROSA ROSA", "UNKNOWN", ""]


@pytest.mark.parametrize(
    ("row", "name"),
    [
        (("ROSES", "Freedom", 50, 25, "", "EC"), "ROSA EC FREEDOM 50CM 25U"), (("ROSES", "Freedom", 0, 25, "", "CO"), "ROSA COL FREEDOM"), (("CARNATIONS", "White", 0, 20, "Fancy", "COL"), "CLAVEL COL FANCY BLANCO 70CM 20U"),
        (("CARNATIONS", "Red", 65, 10, "", "COL"), "MINI CLAVEL COL ROJO 65CM 10U"), (("HYDRANGEAS", "Blue", 60, 1, "", ""), "HYDRANGEA BLUE 60CM 1U"), (("ALSTROEMERIA", "Nadya", 0, 10, "", "COL"), "ALSTROMERIA COL NADYA"),
        (("GYPSOPHILA", "Xlence", 1, 1, "", ""), "PANICULATA XLENCE"), (("CHRYSANTHEMUM", "Anastasia", 70, 10, "", ""), "CRISANTEMO ANASTASIA 70CM 10U"), (("OTHER", "Ruscus", 1, 1, "", ""), "RUSCUS"),
    ],
)
def test_expected_name(spark, row, name):
    df = spark.createDataFrame([row], "s string, v string, z int, p int, g string, o string")
    assert df.select(text.expected_name(*(F.col(c) for c in "svzpgo"))).first()[0] == name


def test_trust(spark):
    rows = [("manual_confirmado", 0, 0, 0.98), ("aprendido_confirmado", 1, 0, 0.85), ("aprendido_confirmado", 9, 0, 0.98), ("aprendido_en_prueba", 3, 0, 0.65), ("aprendido_en_prueba", 3, 2, 0.25), ("ambiguo", 0, 5, 0.10), ("other", 0, 0, 0.40)]
    df = spark.createDataFrame([r[:3] for r in rows], "s string, c int, x int")
    assert [r[0] for r in df.select(checks.trust(F.col("s"), F.col("c"), F.col("x"))).collect()] == [r[3] for r in rows]

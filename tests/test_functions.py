"""Scalar functions against worked examples and plain Python."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.functions import amounts, dates, dims, identifiers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("code", "valid"), [("8435430627640", True), ("8435430627840", False), ("843543062764", False), ("", False)])
def test_ean13(spark, code, valid):
    assert one(spark, identifiers.ean13_valid(F.lit(code))) is valid


@pytest.mark.parametrize(("iban", "valid"), [("ES91 2100 0418 4502 0005 1332", True), ("ES9121000418450200051333", False), ("DE89370400440532013000", True), ("GB82 west 1234 5698 7654 32", True), ("ZZ12345", False), ("DE8937040044053201300", False)])
def test_iban(spark, iban, valid):
    assert one(spark, identifiers.iban_valid(identifiers.iban_normalised(F.lit(iban)))) is valid


@pytest.mark.parametrize(("x", "f", "valid"), [("12345678Z", "nif_valid", True), ("12345678A", "nif_valid", False), ("X1234567L", "nie_valid", True), ("X1234567A", "nie_valid", False), ("A28017895", "cif_valid", True), ("A28017896", "cif_valid", False), ("", "cif_valid", False)])
def test_spanish_ids(spark, x, f, valid):
    assert one(spark, getattr(identifiers, f)(F.lit(x))) is valid


def test_repair(spark):
    r = spark.range(1).select(identifiers.repair(F.lit("123456795"), identifiers.nif_valid).alias("x")).first()["x"]
    assert (r["value"], r["provenance"]) == ("12345679S", "repaired")
    r = spark.range(1).select(identifiers.repair(F.lit("12345678Z"), identifiers.nif_valid).alias("x")).first()["x"]
    assert (r["value"], r["provenance"]) == ("12345678Z", "read")


@pytest.mark.parametrize(("shown", "convention", "digits", "minor"), [("121,00", "comma", 2, 12100), ("1.234,56", "comma", 2, 123456), ("1,234.56", "dot", 2, 123456), ("28080", "comma", 2, 2808000), ("8.741", "comma", 2, 874100), ("5,00-", "comma", 2, -500), ("-5,00", "comma", 2, -500), ("1-2", "comma", 2, None), ("121,00€", "comma", 2, None), ("1,234", "comma", 2, None), ("12", "dot", 0, 12), ("", "dot", 2, None), (" 7 ", "dot", 3, 7000), ("99999999999999999", "dot", 2, None)])
def test_amounts(spark, shown, convention, digits, minor):
    assert one(spark, amounts.parse_amount(F.lit(shown), F.lit(convention), F.lit(digits))) == minor


@pytest.mark.parametrize(("shown", "said"), [("1.234,56", "comma"), ("1,234.5", "dot"), ("12,50", "comma"), ("12.5", None), ("1.234", None), ("-12.50", "dot"), ("1.2.30", None), ("", None)])
def test_convention(spark, shown, said):
    assert one(spark, amounts.amount_convention(F.lit(shown))) == said


def test_rates_and_tolerance(spark):
    assert one(spark, amounts.parse_rate(F.lit("21"))) == 2100 and one(spark, amounts.parse_rate(F.lit("5.25"))) == 525
    assert one(spark, amounts.parse_rate(F.lit("101"))) is None and one(spark, amounts.parse_rate(F.lit("1.234"))) is None
    big = 10**15
    assert one(spark, amounts.tax_within_tolerance(F.lit(big), F.lit(big // 5), F.lit(2000))) is True
    assert one(spark, amounts.tax_within_tolerance(F.lit(10000), F.lit(2102), F.lit(2100))) is False
    assert one(spark, amounts.minor_from_double(F.lit(84.273), F.lit(2))) == 8427
    assert one(spark, amounts.format_amount(F.lit(-5), F.lit(2))) == "-0.05" and one(spark, amounts.format_amount(F.lit(1234), F.lit(0))) == "1234"


@pytest.mark.parametrize(("shown", "order", "day"), [("31/12/2024", "dmy", datetime.date(2024, 12, 31)), ("31.02.2024", "dmy", None), ("12-31-2024", "mdy", datetime.date(2024, 12, 31)), ("2024-12-31", "ymd", datetime.date(2024, 12, 31)), ("31/12-2024", "dmy", None), ("31/12/24", "dmy", None), ("", "dmy", None)])
def test_dates(spark, shown, order, day):
    assert one(spark, dates.parse_date(F.lit(shown), F.lit(order))) == day


def test_names(spark):
    n = lambda x: one(spark, text.name_normalised(F.lit(x)))
    assert n("belegDatum") == "beleg datum" and n("Straße_Nr.") == "strasse nr"
    s = lambda a, b: one(spark, text.similarity(F.lit(a), F.lit(b)))
    assert s("belegdatum", "datum") == 0.9 and s("a", "a") == 1.0 and s("", "a") == 0.0
    assert one(spark, text.supplier_normalised(F.lit("  Ñandú   S.L. "))) == "ñandú s.l."
    assert one(spark, text.country_of_locale(F.lit("es_es"))) == "ES"


def test_fixed_values():
    assert len(dims.CURRENCY_DIGITS) == 165 and dims.CURRENCY_DIGITS["CLF"] == 4 and dims.CURRENCY_DIGITS["CLP"] == 0
    assert len(dims.IBAN_LENGTHS) == 89 and len(dims.FOLD_FROM) == len(dims.FOLD_TO) == 27

"""Review, countries, lenient readers and stored entries on nulls, ties and repeated rows."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import amounts
from quillstone.operators import country, entries, lenient, review


@pytest.mark.parametrize(("printed", "value"), [("1.234,56 €", 1234.56), ("1,234.56", 1234.56), ("1.234", 1234.0), ("1234.5", 1234.5), ("123 030.00", 123030.0), ("1d", None), ("1,2,3", None), ("", None), (None, None), ("EUR", None)])
def test_last_mark_amount(spark, printed, value):
    assert spark.range(1).select(lenient.last_mark_amount(F.lit(printed).cast("string"))).first()[0] == value


@pytest.mark.parametrize(("url", "want"), [("https://H.example:8443/", ("h.example", 8443)), ("https://h.example", ("h.example", 443)), ("http://h.example", None), ("https://u@h.example", None), ("https://h.example/x", None), ("https://h.example:0", None), ("https://h.example:70000", None), (None, None)])
def test_endpoint(spark, url, want):
    got = spark.range(1).select(review.endpoint(F.lit(url).cast("string"))).first()[0]
    assert (got and tuple(got)) == want


def test_decimals_and_currencies(spark):
    row = spark.range(1).select(*[amounts.parse_decimal(F.lit(t), F.lit(2)) for t in ("-12.5", "1,5", "1.234", "007", "")], amounts.plus(F.lit(1), F.lit(2), F.lit("EUR"), F.lit("USD")), amounts.plus(F.lit(10**15), F.lit(1), F.lit("EUR"), F.lit("EUR"))).first()
    assert tuple(row) == (-1250, None, None, 700, None, None, None)


def test_duplicates_are_flagged_and_nulls_are_not(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id long, hash string")
    got = sorted((tuple(r) for r in entries.flag_duplicates(rows, "id", "hash").collect()), key=repr)
    assert got == [(1, None, False, 1), (2, 1, True, 2), (2, 1, True, 2), (3, None, False, 1), (4, None, False, 1), (5, None, False, 1)]
    assert entries.flag_duplicates(rows.limit(0), "id", "hash").collect() == []


def test_listing_reports_what_it_cannot_read(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, None), (4, "{}")], "id long, body string")
    assert {r["id"]: (r["readable"], r["a"]) for r in entries.listing(rows, "a long", "id", "body").collect()} == {1: (True, 1), 2: (False, None), 3: (False, None), 4: (True, None)}


def test_a_country_counts_beside_an_address(spark):
    lines = [("a", 0, ["28013", "Madrid"]), ("a", 1, ["España"]), ("b", 0, ["España"]), ("b", 1, ["x"]), ("b", 2, ["28013"]), ("c", 0, ["DE123456789"]), ("d", 0, [])]
    got = {r["doc"]: (r["country"], r["reason"]) for r in country.detect(spark.createDataFrame(lines, "doc string, line_no int, words array<string>"), ["doc"], "doc").collect()}
    assert got == {"a": ("ES", None), "b": (None, "noEvidence"), "c": ("DE", None), "d": (None, "noEvidence")}


def test_a_figure_is_captured_once(spark):
    box = "doc int, {} int, {} , line_no int, x0 int, x1 int, top int, bottom int"
    terms = spark.createDataFrame([(1, 0, "tip", 0, 0, 10, 0, 10), (1, 1, "tip", 0, 20, 30, 0, 10), (1, 2, None, 0, 0, 10, 0, 10)], box.format("term_no", "hint string"))
    figures = spark.createDataFrame([(1, 7, 500, 0, 12, 18, 0, 10)], box.format("figure_no", "value int"))
    assert [tuple(r) for r in entries.surcharges(terms, figures, "doc", 5).collect()] == [(1, 0, "tip", 7, 500)]

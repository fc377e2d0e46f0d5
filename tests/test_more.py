"""Adjudication, dates in text, e-invoices, labels and probes on nulls, odd and damaged inputs."""

import unicodedata

from pyspark.sql import functions as F

from quillstone.functions.text import label_normalised
from quillstone.operators import adjudicate, einvoices, evaluation, lenient, records

TEXTS = {
    "BASE 100,00\nIVA 21% 21,00\nTOTAL 121,00": (121.0, 100.0, 21.0, "confirmed"),
    "BASE 100,00\nBASE 200,00\nCUOTA 42,00\nIVA 21%\nTOTAL 242,00\nTOTAL 142,00": (242.0, 200.0, 42.0, "confirmed"),  # the printed rate picks the trio
    "A PAGAR\n01/02/2024\n\n12,10": (12.1, None, None, "read"), "TOTAL\nBASE\n5,00": (5.0, None, None, "read_weak"),
    "TOTAL 0,00\n55,00 EUR": (0.0, None, None, "read"), "TOTAL IBAN 1234\nTOTAL 12": (1234.0, None, None, "read_weak"),
    "Tarifa 12,50 EUR\npor 2 dias 25,00 EUR": (25.0, None, None, "read"), "10,00 USD\n20,00 USD\n21%": (20.0, 20.0, 0.0, "read"),
    "uno 1,00\ndos 2,00\ntres 3,00\nref 99999,00": (3.0, None, None, "read_weak"), "BASE IMP. 50,00\n10 %": (55.0, 50.0, 5.0, "derived"),
    "": (None, None, None, "missing"), "sin nada": (None, None, None, "missing"), "SUBTOTAL 10,00\nTOTAL 12,10\nTAX 2,10": (12.1, 10.0, 2.1, "confirmed"),
}


def test_adjudication(spark):
    rows = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "k int, text string")
    got = {r["k"]: (r["gross"], r["net"], r["tax"], r["state"]) for r in adjudicate.adjudicate(rows, "k").collect()}
    for k, (text, want) in enumerate(TEXTS.items()):
        assert got[k] == want, text
    assert got[99] == (None, None, None, "missing") and adjudicate.adjudicate(rows.limit(0), "k").collect() == []


def test_a_vote_counts_abroad(spark):
    rows = spark.createDataFrame([(1, "30,00 MAD\nMAD", 30.5), (2, "TOTAL 10,00 EUR", 9.0)], "k int, text string, voted double")
    got = {r["k"]: (r["gross"], r["gross_method"], r["tax"]) for r in adjudicate.adjudicate(rows, "k", voted=F.col("voted")).collect()}
    assert got == {1: (30.5, "voted", 0.0), 2: (10.0, "label", None)}


def test_line_figures(spark):
    cases = {"2 x 10,50 = 21,00": [10.5, 21.0], "21,00 % 5,00": [5.0], "12/03/2024 9,99": [9.99], "1234567": [], "123 030.00": [123030.0], "40 31": [40.0], "": [], "no": [], "1.234,56 7": [1234.56]}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", adjudicate.line_figures(F.col("t")).alias("f")).collect()
    assert {r["t"]: r["f"] for r in rows} == cases


def test_dates_in_text(spark):
    rows = spark.createDataFrame([(1, "el 8/ago/26 y 08.08.2026, 31/02/2024, 2026-08-09 1/1/1999"), (2, None), (3, ""), (4, "nada 12")], "k int, text string")
    assert [(r["k"], r["form"], r["raw"], str(r["day"])) for r in lenient.found_dates(rows, "k").orderBy("k", "form", "nth").collect()] == [(1, 0, "8/ago/26", "2026-08-08"), (1, 1, "08.08.2026", "2026-08-08"), (1, 2, "2026-08-09", "2026-08-09")]


def test_labels_equal_the_unicode_rule(spark):
    words = ["TOTAL", "«Importe»", "Straße", "ﬁnal", "Nº", "N.º", "Ａbc", "½", "É́x", "ŀa", "..", "", "Ünïcödé!", "ẞ", "ŉ", "№ 5", "İ"]

    def plain(w):
        out = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).casefold()
        while out and not out[0].isalnum():
            out = out[1:]
        while out and not out[-1].isalnum():
            out = out[:-1]
        return out

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", label_normalised(F.col("w")).alias("n")).collect()
    assert {r["w"]: r["n"] for r in got} == {w: plain(w) for w in words}


def test_einvoices(spark):
    ubl = f'<Invoice xmlns="{einvoices.UBL}Invoice-2"><ID>7</ID><DocumentCurrencyCode/><TaxTotal><TaxSubtotal><TaxableAmount>1</TaxableAmount><TaxAmount>0.21</TaxAmount><TaxCategory><Percent>21</Percent></TaxCategory></TaxSubtotal></TaxTotal></Invoice>'
    rows = [(1, ubl), (2, "<Invoice><ID>7"), (3, None), (4, ""), (5, "<Other/>"), (6, '<Invoice xmlns="urn:else"><ID>1</ID></Invoice>'), (7, "not xml"), (8, ubl.replace("Invoice", "CreditNote")), (9, "<Invoice><ID>8</ID></Invoice>"), (9, "<Invoice><ID>8</ID></Invoice>")]
    got = [(r["k"], r) for r in einvoices.read(spark.createDataFrame(rows, "k int, x string"), "k", "x").collect()]
    assert len(got) == 10
    by = dict(got)
    assert by[1]["shape"] == "Invoice" and by[1]["doc_number"]["value"] == "7" and by[1]["doc_number"]["provenance"] == "from_xml" and [tuple(x) for x in by[1]["tax_lines"]] == [("21", "1", "0.21")]
    assert by[1]["currency"]["state"] == by[1]["gross_total"]["state"] == "not_in_xml" and by[8]["shape"] == "CreditNote" and by[9]["doc_number"]["value"] == "8"
    assert all(by[k]["shape"] is None and by[k]["doc_number"] is None for k in (2, 3, 4, 5, 6, 7))


def test_probes(spark):
    found = spark.createDataFrame([(1, 100), (1, None), (2, 5), (4, 9)], "d int, cents int")
    totals = spark.createDataFrame([(1, 100), (2, 100), (3, 100), (4, None)], "d int, total int")
    assert {tuple(r) for r in evaluation.probe_outcomes(found, totals, "d", "cents", "total").collect()} == {(1, "yes", 2, 1), (2, "no", 1, 0), (3, "no label found", 0, 0), (4, "not probed", 0, 0)}


def test_scans(spark):
    rows = spark.createDataFrame([("B 1234567 4, DE123456789 X-12345678-B",), ("",), (None,)], "t string")
    assert [[tuple(x)[:2] for x in r[0] or []] for r in rows.select(lenient.tax_ids(F.col("t"))).collect()] == [[("B12345674", "ES_CIF"), ("X12345678", None), ("DE123456789", "DE_USTID")], [], []]
    cases = {"INVOICE AB-12": "AB-12", "nº/FECHA documento 12345678": "12345678", "código de control: XY99ZZ": "XY99ZZ", "recibo": None, "": None}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", lenient.document_number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == cases
    masks = {"4555 XXXX 1234": "4555xxxxxx1234", "**** 9876": "xxxx9876", "1234": None}
    got = spark.createDataFrame([(t,) for t in masks], "t string").select("t", lenient.card_mask(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == masks


def test_kinds_come_before_names(spark):
    core = spark.createDataFrame([("number", "total", 0, ["Total"]), ("date", "day", 1, ["Fecha"])], "kind string, core_field string, core_no int, synonyms array<string>")
    columns = spark.createDataFrame([("number", "f1", 0, "totalAmount"), ("string", "f2", 1, "Total"), ("date", "f3", 2, None)], "kind string, field_id string, field_no int, name string")
    got = {(r["core_field"], r["field_id"]): r["score"] for r in records.typed_matches(core, columns).collect()}
    assert set(got) == {("total", "f1"), ("day", "f3")} and got["total", "f1"] > 0.5 and got["day", "f3"] == 0.0

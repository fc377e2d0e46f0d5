"""Queries against their SQL on keys and shapes that the small tables don't have."""

import os
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  fills the catalogue
from quillstone.operators import einvoices, layout, negative
from quillstone.plans import catalogue, extract
from quillstone.sources.remote_service import PER_PAGE, Folder


def against_sql(spark, name, where, **tables):
    """The query's rows over tables (DataFrames by name), held against DuckDB's; returns them sorted."""
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t, df in tables.items():
        df.write.parquet(f"{where}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{where}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(where))
    cols = ", ".join(got.columns)
    want = c.execute(f"select {cols} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == sorted(want, key=repr)
    return found


def test_a_documents_number_is_no_tax_identifier(spark, tmp_path):
    found = against_sql(spark, "scanned_facts", tmp_path, supplier=spark.createDataFrame([(k,) for k in (0, 9, 9999, 10014, 10017, 59997, 123456)], "s_suppkey bigint"))
    assert any(ids == "B00100144:ES_CIF|DE000010014:DE_USTID" and number == "F-10010014" for _, ids, number, _ in found)


def test_the_pages_of_a_folder_are_cut_from_one_listing(tmp_path, monkeypatch):
    made = Folder(str(tmp_path))
    ids = sorted(made.create("t", str(k), {"n": k}) for k in range(2 * PER_PAGE + 5))
    assert made.create("t", "7", {"n": -1}) in ids
    listings = []
    for name in ("scandir", "listdir"):
        monkeypatch.setattr(os, name, lambda *a, f=getattr(os, name): listings.append(a) or f(*a))
    service = Folder(str(tmp_path))
    pages = [service.page("t", n) for n in range(4)]
    assert [len(p) for p in pages] == [PER_PAGE, PER_PAGE, 5, 0] and [r["id"] for p in pages for r in p] == ids and len(listings) == 1
    assert sorted(r["fields"]["n"] for p in pages for r in p) == list(range(2 * PER_PAGE + 5)) and Folder(str(tmp_path)).page("other", 0) == []


WORDS = "doc_id string, pass_id string, page_index int, word_no int, text string, x0 int, x1 int, top int, bottom int"


def test_lines_of_words_that_lie_alike(spark):
    r, rows = random.Random(4), []
    for page in range(40):
        for k in range(page):
            top, x0 = r.randrange(6) * 4, r.randrange(3)
            rows.append(("d", "p", page, r.randrange(3), r.choice(["a", "é", "z", "A"]), x0, x0 + r.randrange(2), top, top + r.randrange(8)))
    want = {}
    for page in range(40):
        line, low, high = -1, 0, 0
        for w in sorted((w for w in rows if w[2] == page), key=lambda w: (w[7], w[5], w[6], w[8], w[4].encode(), w[3])):
            if line >= 0 and 2 * (min(high, w[8]) - max(low, w[7])) >= min(high - low, w[8] - w[7]):
                low, high = min(low, w[7]), max(high, w[8])
            else:
                line, low, high = line + 1, w[7], w[8]
            want.setdefault((page, line), []).append((w[5], w[3], w[4], w[6], w[7], w[8]))
    found = layout.lines(spark.createDataFrame(rows, WORDS).repartition(3)).collect()
    assert len(found) == len(want)
    for x in found:
        words = sorted(want[x["page_index"], x["line_no"]], key=lambda w: (w[0], w[1], w[2].encode(), *w[3:]))
        assert [tuple(w) for w in x["words"]] == words and x["text"] == " ".join(w[2] for w in words)
        assert (x["x0"], x["x1"], x["top"], x["bottom"]) == (min(w[0] for w in words), max(w[3] for w in words), min(w[4] for w in words), max(w[5] for w in words))


def test_lines_with_nulls(spark):
    rows = [("d", "p", 0, 0, "a", 0, 5, 0, 10), ("d", "p", 0, 1, None, 9, 12, 1, 9), ("d", "p", 0, 2, "b", None, 7, 2, 10), ("d", "p", 0, 3, "c", 1, 2, None, 3), ("d", "p", 0, 4, "e", 1, 2, 40, None)]
    got = {r["line_no"]: (r["text"], r["x0"], r["top"], r["bottom"]) for r in layout.lines(spark.createDataFrame(rows, WORDS)).collect()}
    assert sum(len(t.split()) for t, *_ in got.values()) == 4 and ("b a", 0, 0, 10) in got.values()


def test_a_plan_of_amounts_is_small(spark):
    """Lines are made once, so the last plan reads them: the driver held all of it at once."""
    words = spark.createDataFrame([("d", "p", 0, 0, "TOTAL", 0, 9, 0, 10), ("d", "p", 0, 1, "5,00", 10, 19, 0, 10)], WORDS)
    found = extract.extract(words, spark.createDataFrame([("total", "es", "TOTAL", None)], "kind string, language string, term string, hint string"))
    assert found.select("doc_id", "gross").collect()[0]["gross"] == 500
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("LogicalRDD") <= 3


def test_an_einvoice_is_parsed_once(spark):
    ubl = f'<!-- <Order> --><u:Invoice xmlns:u="{einvoices.UBL}Invoice-2"><ID> <![CDATA[7]]>&amp;<b>8</b> </ID><ID>9</ID>%s<TaxTotal><TaxAmount>3</TaxAmount></TaxTotal></u:Invoice>'
    line = "<TaxTotal><TaxSubtotal><TaxableAmount>%s</TaxableAmount><TaxAmount>1</TaxAmount>%s</TaxSubtotal></TaxTotal>"
    rate = "<TaxCategory><Percent>2<!-- -->1</Percent></TaxCategory>"
    rows = [(1, ubl % (line % (10, rate) + line % (20, ""))), (2, ubl % "" + "<more/>"), (3, "<Invoice><ID>1</ID></Wrong>"), (4, "  "), (5, ubl.replace("Invoice-2", "Order-2").replace(einvoices.UBL, "urn:else:") % "")]
    found = einvoices.read(spark.createDataFrame(rows, "k int, x string"), "k", "x")
    got = {r["k"]: r for r in found.collect()}
    assert got[1]["shape"] == "Invoice" and got[1]["doc_number"]["value"] == "7&8" and got[1]["tax_total"]["value"] == "3" and got[1]["net_total"]["state"] == "not_in_xml"
    assert [tuple(x) for x in got[1]["tax_lines"]] == [("2", "10", "1"), ("1", "20", "1")]
    assert all(got[k]["shape"] is None and got[k]["doc_number"] is None and got[k]["tax_lines"] is None for k in (2, 3, 4, 5))
    assert "xpath" not in found._jdf.queryExecution().analyzed().toString()


def test_a_words_box_lies_in_few_cells(spark):
    wide, high = (F.size(negative._cells(F.lit(a - 4000), F.lit(b + 4000), 4000)) for a, b in ((9000, 16000), (14000, 25000)))
    assert spark.range(1).select(wide * high).first()[0] <= 6  # it was 25
    r = random.Random(7)
    box = lambda: (x := r.randrange(-60_000, 60_000), x + r.randrange(20_000), y := r.randrange(-60_000, 60_000), y + r.randrange(20_000))
    a, b = ([(k % 3, *box()) for k in range(n)] for n in (150, 40))
    gap = lambda p, q, k: max(max(p[k], q[k]) - min(p[k + 1], q[k + 1]), 0)
    want = sorted((*p, any(q[0] == p[0] and gap(p, q, 1) ** 2 + gap(p, q, 3) ** 2 <= 4000**2 for q in b)) for p in a)
    kind = "doc_id int, x0 int, x1 int, top int, bottom int"
    assert sorted(map(tuple, negative.flag_context(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ["doc_id"], 4000).collect())) == want


def test_adjudicated_cents_are_those_of_the_sql(spark, tmp_path):
    rows = [(51155, 84343.5), (129299, 156499.5), (7931, 169115.5), (3, 100.0), (8, 121.45), (1, 77.77)]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_totalprice double").withColumn("o_orderdate", F.timestamp_seconds(F.lit(800_000_000)))
    assert (51155, 102055.63) in [x[:2] for x in against_sql(spark, "adjudication", tmp_path, orders=orders)]

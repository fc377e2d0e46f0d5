"""Operators and the text route on small pages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import dims
from quillstone.operators import binding, consensus, layout, negative, photo, records, solver, terms
from quillstone.plans import extract
from quillstone.sources import remote_table, words_json

WORDS = "doc_id string, pass_id string, page_index int, word_no int, text string, x0 int, x1 int, top int, bottom int"


def page(doc, lines, pass_id="p1", gap=20000):
    out, n = [], 0
    for k, cells in enumerate(lines):
        x = 20000
        for w in cells.split():
            out.append((doc, pass_id, 0, n, w, x, x + 6000 * len(w), 50000 + k * gap, 60000 + k * gap))
            x += 6000 * len(w) + 4000
            n += 1
    return out


def test_text_route(spark):
    rows = page("a", ["FACTURA 7", "BASE 100,00", "IVA 21 % 21,00", "TOTAL 121,00"], gap=60000) + page("b", ["TOTAL 50,00", "propina 2,00"], gap=60000) + page("c", ["nothing here"])
    for _ in range(2):
        got = {r["doc_id"]: r for r in extract.extract(spark.createDataFrame(rows, WORDS), dims.terms(spark)).collect()}
        assert (got["a"]["outcome"], got["a"]["gross"], got["a"]["net"], got["a"]["tax"], got["a"]["gross_confidence"], got["a"]["needs_review"]) == ("read", 12100, 10000, 2100, "green", False)
        assert got["b"]["gross"] == 5000 and got["b"]["needs_review"] and got["c"]["gross"] is None and got["c"]["needs_review"]
        random.Random(1).shuffle(rows)  # the order of arrival says nothing


def test_recognised_route_votes(spark):
    passes = [page("a", [f"TOTAL {v}"], pass_id=p, gap=60000) for p, v in (("p1", "12,00"), ("p2", "12,00"), ("p3", "13,00"))]
    tie = [page("b", [f"TOTAL {v}"], pass_id=p) for p, v in (("p1", "12,00"), ("p2", "13,00"))]
    got = {r["doc_id"]: r for r in extract.extract(spark.createDataFrame(sum(passes + tie, []), WORDS), dims.terms(spark), route="pdf-ocr").collect()}
    assert got["a"]["gross"] == 1200 and got["b"]["gross"] is None and got["b"]["outcome"] == "disputed"


def test_terms(spark):
    lines = spark.createDataFrame([(1, "TOTAL A PAGAR 5"), (2, "€TOTAL"), (3, "subtotal: total"), (4, None), (5, "Razón social razon social")], "id long, text string")
    found = {(r["id"], r["start"], r["term"], r["language"]) for r in terms.find_terms(lines, dims.terms(spark), ["id"]).collect()}
    assert (1, 1, "TOTAL A PAGAR", "es") in found and (1, 7, "A PAGAR", "es") in found and not any(x[0] in (2, 4) for x in found)
    assert not any(x[:2] == (1, 1) and x[2] in ("TOTAL", "Total") for x in found)
    assert {(5, 1, "Razón social", "es"), (5, 14, "Razón social", "es"), (3, 11, "TOTAL", "es"), (3, 11, "Total", "en"), (3, 1, "Subtotal", "en")} <= found


def fold(words):
    out, top, bottom = [], None, None
    for w in sorted(words, key=lambda w: (w[7], w[5], w[6], w[8], w[4], w[3])):
        if out and 2 * (min(bottom, w[8]) - max(top, w[7])) >= min(bottom - top, w[8] - w[7]):
            out[-1].append(w)
            top, bottom = min(top, w[7]), max(bottom, w[8])
        else:
            out.append([w])
            top, bottom = w[7], w[8]
    return [" ".join(w[4] for w in sorted(line, key=lambda w: (w[5], w[3]))) for line in out]


def test_lines_equal_a_plain_fold(spark):
    r = random.Random(5)
    pages = {f"d{k}": [(f"d{k}", "p", 0, n, f"w{n}", x := r.randrange(500), x + 20, t := r.randrange(300), t + r.randint(5, 30)) for n in range(40)] for k in range(12)}
    got = layout.lines(spark.createDataFrame(sum(pages.values(), []), WORDS))
    for doc, words in pages.items():
        assert [x["text"] for x in got.filter(F.col("doc_id") == doc).orderBy("line_no").collect()] == fold(words)
    assert layout.rows_text(got).count() == 12


def test_negative_context_equals_all_pairs(spark):
    r = random.Random(2)
    box = lambda n: [(k % 3, k, x := r.randrange(-300, 900), x + r.choice([5, 60, 400]), y := r.randrange(900), y + r.choice([5, 90])) for k in range(n)]
    a, b = box(200), box(25)
    gap = lambda p, q, s, t: max(max(p, s) - min(q, t), 0)
    want = {x[1] for x in a if any(x[0] == y[0] and gap(x[2], x[3], y[2], y[3]) ** 2 + gap(x[4], x[5], y[4], y[5]) ** 2 <= 50**2 for y in b)}
    schema = "doc_id int, n int, x0 int, x1 int, top int, bottom int"
    kept, gone = negative.split_by_context(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["doc_id"], 50)
    assert sorted(x["n"] for x in gone.collect()) == sorted(want) and sorted(x["n"] for x in kept.collect()) == sorted(set(range(200)) - want)


@pytest.mark.parametrize(("votes", "kind", "value"), [(["a", "a", "b"], "agreed", "a"), (["a", "b"], "none", None), (["a", "a", "b", "b"], "none", None), (["a"], "single", "a"), ([None], "none", None), (["a", None], "single", "a")])
def test_consensus(spark, votes, kind, value):
    got = consensus.consensus(spark.createDataFrame([(1, v) for v in votes], "id int, value string"), ["id"]).first()
    assert (got["kind"], got["value"]) == (kind, value)


def test_solver_plans_an_equality_join(spark):
    ops = spark.createDataFrame([("a", "base", 1652), ("a", "tax", 347), ("a", "gross", 1999), ("b", "base", 1652), ("b", "tax", 347), ("b", "gross", 1998), ("c", "base", 10000), ("c", "tax", 2100), ("d", "base", 10000), ("d", "tax", 2100)], "doc_id string, role string, minor long")
    assert [tuple(r) for r in solver.triples(ops).collect()] == [("a", 1652, 347, 1999)]
    rates = spark.createDataFrame([("b", 2100), ("c", 2100), ("c", 2100), ("d", None)], "doc_id string, rate_bp int")
    got = {r["doc_id"]: (r["outcome"], r["gross"]) for r in solver.solve(ops, rates).collect()}
    assert got == {"a": ("read", 1999), "b": ("single", 1998), "c": ("derived", 12100), "d": ("single", None)}
    plan = solver.triples(ops)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_photo_readers(spark):
    text = "CAFE\nFECHA 07/03/24\nBASE 10,00 IVA 21% 2,10\nTOTAL 12,10"
    rows = spark.createDataFrame([(1, text), (2, "TOTAL 5,00"), (3, ""), (4, "12,10 10,00 2,10 21%")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in photo.read_receipts(rows, dims.COUNTRIES["ES"]["rates"]).collect()}
    assert [got[1][c] for c in ("net", "vat", "gross", "rate", "via")] == [10.0, 2.1, 12.1, 21.0, "arithmetic"] and str(got[1]["date"]) == "2024-03-07"
    assert got[2]["gross"] == 5.0 and got[2]["via"] == "label" and got[3]["via"] is None and got[4]["gross"] == 12.1


def test_photo_receipts_that_share_an_id_do_not_mix(spark):
    rows = spark.createDataFrame([(1, "TOTAL 5,00"), (1, "BASE 1,00\nTOTAL 1.234,56"), (1, None)], "doc_id long, text string")
    assert sorted((r["gross"] or 0, r["net"] or 0) for r in photo.read_receipts(rows, [2100]).collect()) == [(0, 0), (5.0, 0), (1234.56, 1.0)]


def test_labels_bind_by_their_line(spark):
    schema = "doc int, line_no int, x0 int, x1 int, top int, bottom int"
    lines = spark.createDataFrame([(1, 0, 0, 100, 0, 10), (1, 1, 0, 300, 20, 30), (1, 2, 0, 100, 90, 99)], schema)
    labels = spark.createDataFrame([("l", 1, 0, 50, 100, 0, 10)], "label_id string, " + schema)
    values = spark.createDataFrame([(1, 0, 0, 40, 20, 30, 7), (1, 1, 0, 40, 20, 30, 1), (1, 1, 200, 300, 20, 30, 2), (1, 2, 60, 100, 90, 99, 3)], schema + ", value int")
    # on the next line the value at 200 lies right of the label, and that at 0 ends left of it
    assert [tuple(r) for r in binding.bind_labels(labels, values.filter("line_no > 0"), lines, ["doc"]).collect()] == [(1, "l", 2, False)]
    assert binding.probe_labels(labels, values.filter("line_no = 1"), ["doc"]).collect() == []


def test_equal_sends_stay_rows_of_their_own(spark):
    sends = spark.createDataFrame([(1, "u", 100), (1, "u", 100)], "id int, user string, at int").withColumn("at", F.timestamp_seconds("at"))
    made = spark.createDataFrame([("u", 90)], "user string, made int").withColumn("made", F.timestamp_seconds("made"))
    assert [(r["candidates"], r["decision"]) for r in records.reconcile(sends, made, "user", "at", "made").collect()] == [(1, "adopt")] * 2


def test_mappings_are_greedy_with_a_margin(spark):
    rows = [("t", "total", 0, "f1", 0, 0.9), ("t", "total", 0, "f2", 1, 0.88), ("t", "date", 1, "f3", 2, 1.0), ("t", "tax", 2, "f2", 1, 0.95)]
    df = spark.createDataFrame(rows, "t string, core_field string, core_no int, field_id string, field_no int, score double")
    assert {tuple(r) for r in records.propose_mappings(df, "t").collect()} == {("t", "date", "f3"), ("t", "tax", "f2"), ("t", "total", "f1")}


def test_sources(spark, tmp_path):
    words = [{"text": "TOTAL", "x0": 1.0, "x1": 2.5, "top": 3.0, "bottom": 4.0}, {"text": "a b", "x0": 0.0, "x1": 1.0, "top": 0.0, "bottom": 1.0}]
    (tmp_path / "d1.tool-words.json").write_text(json.dumps({"doc_id": "d1", "tool": "tool", "pages": [{"index": 0, "width": 10.0, "height": 20.0, "words": words}]}))
    assert [tuple(r)[5:] for r in words_json.read_word_pages(spark, str(tmp_path)).collect()] == [(0, "TOTAL", 1000, 2500, 3000, 4000)]
    (tmp_path / "t.csv").write_text('﻿doc_id;a;b;c;d\nx;"1.234,50";si;si;\ny;"1,00";no;no;"2,50"\n', encoding="utf-8")
    assert {tuple(r) for r in words_json.read_totals(spark, str(tmp_path / "t.csv")).collect()} == {("x", 123450), ("y", 250)}
    (tmp_path / "page-0.json").write_text(json.dumps([{"id": k, "fields": {"n": k}} for k in range(100)]))
    (tmp_path / "page-1.json").write_text(json.dumps([{"id": "z", "fields": {"n": "é"}}]))
    spark.dataSource.register(remote_table.RemoteRecords)
    got = spark.read.format("remote_records").load(str(tmp_path))
    assert got.count() == 101 and got.filter("id = 'z'").first()["fields"] == {"n": "é"}
    sent = remote_table.payloads(spark.createDataFrame([(1, None, "q")], "a int, b int, c string"), {"a": "A", "b": "B"}).first()["payload"]
    assert json.loads(sent) == {"fields": {"A": "1"}}

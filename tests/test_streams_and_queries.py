"""Streams against batch, groups against plain Python, and the registered queries."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillstone.operators import heuristics, records
from quillstone.plans import catalogue
from quillstone.streaming import history

STATES = list(records.TRANSITIONS)


def test_stream_equals_replay(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, 1000 + k, k % 5) for k in range(200)]
    r.shuffle(rows)
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long").select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id")
    events.write.parquet(str(tmp_path / "events.parquet"))
    read = spark.read.parquet(str(tmp_path / "events.parquet"))
    to = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % 8 + 1).cast("int"))
    want = records.replay(read.withColumn("to_state", to), "user_id", ["ts", "event_id"])
    got = history.replay_stream(spark, str(tmp_path / "events.parquet"), read.schema, STATES)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_extensions_are_streams(spark, tmp_path):
    spark.createDataFrame([(1,)], "user_id long").select("user_id", F.timestamp_seconds(F.lit(5)).alias("ts"), F.lit("h").alias("hash"), F.timestamp_seconds(F.lit(5)).alias("created_at")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    assert history.session_activity(stream).isStreaming and history.flag_duplicates(stream).isStreaming


def test_overlap_lines_and_word_matches(spark):
    rows = [("a", 0, 0, 10), ("a", 1, 4, 14), ("a", 2, 9, 19), ("a", 3, 30, 40), ("b", 7, 0, 1)]
    got = heuristics.overlap_lines(spark.createDataFrame(rows, "doc_id string, word_no int, top int, bottom int"), ["doc_id"])
    assert {tuple(r) for r in got.collect()} == {("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("a", 3, 3), ("b", 7, 7)}
    word = "doc_id string, word_no int, text string, cx double, cy double"
    a = spark.createDataFrame([("a", 0, "x", 0.0, 0.0), ("a", 1, "x", 5.0, 0.0), ("a", 2, "y", 0.0, 0.0)], word)
    b = spark.createDataFrame([("a", 8, "x", 4.0, 0.0), ("a", 9, "x", 1.0, 0.0), ("a", 7, "z", 0.0, 0.0)], word)
    assert {(r["ref_no"], r["cand_no"]) for r in heuristics.match_words(a, b, ["doc_id"]).collect()} == {(0, 9), (1, 8)}


def test_text_repair(spark):
    for t in ("España", "já vu – “x” €", "plain", "日本", "Ã", ""):
        shown = spark.range(1).select(heuristics.misread_text(F.lit(t)).alias("m")).select(heuristics.repaired_text(F.col("m"))).first()[0]
        assert shown == t
    assert spark.range(1).select(heuristics.repaired_text(F.lit("ñ alone"))).first()[0] == "ñ alone"


def test_every_query_has_a_name_and_its_sql_is_known():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(catalogue.QUERIES) >= 90
    assert {n for n in catalogue.QUERIES if n not in o} == set()


@pytest.mark.parametrize("gone", ["quillstone/llm", "corpus_pipeline.py"])
def test_the_rest_stands_without_the_training_operators(tmp_path, gone):
    root = Path(__file__).resolve().parent.parent
    for p in ("quillstone", "corpus_pipeline.py", "__spark_entry__.py"):
        if (root / p).is_dir():  # what may be taken away need not be there
            shutil.copytree(root / p, tmp_path / p, ignore=lambda d, names: [n for n in names if gone == f"{Path(d).relative_to(root)}/{n}"])
        elif (root / p).exists() and p != gone:
            shutil.copy(root / p, tmp_path / p)
    assert not (tmp_path / gone).exists()
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.catalogue.QUERIES)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=100)


def test_nothing_else_imports_them():
    root = Path(__file__).resolve().parent.parent
    for p in (root / "quillstone").rglob("*.py"):
        assert "llm" in p.parts or "quillstone.llm" not in p.read_text(encoding="utf-8"), p


def test_whole_tables_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    lines = [(o, n, float(r.randint(100, 9999)), r.randint(1, 900), r.randint(1, 9000)) for o in (95, 7, 12, 20) for n in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    talk = [(1, t, " ".join(r.choice("a b c d".split()) for _ in range(6))) for t in range(6)]
    spark.createDataFrame(talk, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    docs = [(1, "café", "en"), (2, "señor", None), (3, None, "es"), (4, "über", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: sorted((tuple(x) for x in catalogue.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    base, tax, gross = set(), set(), set()
    for o, n, p, *_ in lines:
        m, t = round(p * 100), round(p * 100) * 21 // 100
        base.add((o, m))
        tax |= {(o, t)} if n == 1 or o % 5 == 0 else set()
        gross |= {(o, m + t)} if o % 3 > 0 and n <= o % 8 else set()
    triples = sorted(((o, b, t, b + t) for o, b in base for q, t in tax if o == q and (o, b + t) in gross), key=repr)
    assert run("amount_triples") == triples and sum(x[0] == 95 for x in triples) == 7
    solved = {x[0]: x[1] for x in run("breakdown_solve")}
    assert solved[95] == "ambiguous" and solved[7] == "read" and set(solved) == {95, 7, 12, 20}
    fits = {(o, b, t) for o, b in base for q, t in tax if o == q and abs(t * 10000 - b * 2100) <= 10000}
    one = lambda o: [x[1:] for x in fits if x[0] == o]
    assert [x[2:] for x in run("tax_slots") if x[1] == 2100] == [one(x[0])[0] if len(one(x[0])) == 1 else (None, None) for x in run("tax_slots") if x[1] == 2100]
    bags = [{w: t.split().count(w) for w in t.split()} for _, _, t in talk]
    assert run("pass_agreement") == sorted(((1, i, j, sum(min(n, bags[j].get(w, 0)) for w, n in bags[i].items()), 6) for j in range(6) for i in range(j)), key=repr)
    assert run("repaired_text") == sorted(((d, t) for d, t, _ in docs), key=repr)
    box = lambda n, p, s: (n * 9000 + p % 500, n * 9000 + p % 500 + 7000, n // 3 * 14000 + s % 9000, n // 3 * 14000 + s % 9000 + 8000 + p % 3000)
    near = lambda a, b: max(max(a[0], b[0]) - min(a[1], b[1]), 0) ** 2 + max(max(a[2], b[2]) - min(a[3], b[3]), 0) ** 2 <= 4000**2
    want = [(o, n, any(q == o and k % 2 == 0 and near(box(n, p, s), box(k, u, v)) for q, k, _, u, v in lines)) for o, n, _, p, s in lines if n % 2]
    assert run("negative_context") == sorted(want, key=repr) and any(x[2] for x in want if x[0] % 3)


def test_reconcile_needs_every_sent_field(spark):
    at = lambda t: F.timestamp_seconds(t)
    sends = [(1, 7, 1000, {"a": "1", "b": "2"}), (2, 7, 1000, {"a": "9", "b": "2"}), (3, 7, 1000, {"a": "1"}), (4, 7, 1000, {"a": "1", "c": None}), (5, 8, 1000, {"a": "1", "b": "2"}), (6, 7, 1000, None)]
    made = [(7, 990, {"a": "1", "b": "2", "x": "0"}), (7, 995, {"a": "3", "b": "2"}), (8, 800, {"a": "1", "b": "2"})]
    s = spark.createDataFrame(sends, "send_id long, u long, t long, fields map<string,string>").withColumn("t", at("t"))
    r = spark.createDataFrame(made, "u long, made long, fields map<string,string>").withColumn("made", at("made"))
    got = {x["send_id"]: (x["candidates"], x["decision"]) for x in records.reconcile(s, r, "u", "t", "made", fields="fields").collect()}
    assert got == {1: (1, "adopt"), 2: (0, "create"), 3: (2, "ask"), 4: (0, "create"), 5: (0, "create"), 6: (2, "ask")}
    lone = records.reconcile(s.filter("send_id = 3"), r.filter("made < timestamp_seconds(992)"), "u", "t", "made", fields="fields").first()
    assert (lone["candidates"], lone["decision"]) == (1, "ask")


def test_plurality_with_runners_up(spark):
    rows = [("x", v, k) for k, v in enumerate("bacabdae")] + [("y", "z", 0), ("y", "z", 1), ("y", None, 2)]
    got = {x["k"]: tuple(x)[1:] for x in heuristics.plurality(spark.createDataFrame(rows, "k string, v string, n int"), ["k"], "v", "n").collect()}
    assert got == {"x": ("a", 3, 8, False, [("b", 2), ("c", 1)]), "y": ("z", 2, 2, True, [])}

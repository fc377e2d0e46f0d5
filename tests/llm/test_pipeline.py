"""The pipeline's stages, each on what its predecessor kept, and the whole against the stages in a row."""

import random

import corpus_pipeline
from quillstone.llm import simhash
from quillstone.llm.suffix_dedup import LENGTH

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the ing and tion er re".split(), "xx": "zuk bar ol quim ash lo".split()}


def documents():
    r = random.Random(5)
    prose = lambda lang, n: " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(k, prose(lang := r.choice(["en", "xx"]), r.randint(30, 200)), lang) for k in range(80)]
    passage = prose("en", 120)
    rows += [(100 + k, prose("en", 60) + " " + passage + " é " + prose("en", 60), "en") for k in range(4)]
    rows += [(200, rows[3][1], "en"), (201, rows[3][1] + " end", "en"), (202, prose("en", 50) + " password=hunter2hunter2 " + prose("en", 50), "en")]
    rows += [(300, None, None), (301, "", "en"), (302, "12345 !!", "xx"), (303, "日本語のとても長いテキストです" * 30, None), (7, rows[7][1], "xx"), (None, prose("xx", 80), "xx")]
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in rows], passage


def test_stages(spark, tmp_path):
    rows, passage = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append(docs.collect())
    language, near, passages, secrets, packed = kept
    assert {r["doc_id"] for r in rows_of(rows)} - {r["doc_id"] for r in language} == {300, 301, 302, 303}
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(language, SCHEMA)).collect()}
    assert sorted((r["doc_id"] for r in near), key=repr) == sorted({d for d, c in groups.items() if d == c}, key=repr)
    assert 200 not in {r["doc_id"] for r in near} and 3 in {r["doc_id"] for r in near}
    texts = [r["text"] for r in passages]
    assert len(passages) == len(near) and sum(passage[: LENGTH] in t for t in texts) == 0 and all(r["n_chars"] == len(r["text"]) for r in passages)
    clean = {r["doc_id"]: r["text"] for r in near if not 100 <= (r["doc_id"] or 0) < 110}
    assert all(r["text"] == clean[r["doc_id"]] for r in passages if r["doc_id"] in clean)
    assert any("[secret]" in r["text"] for r in secrets) and not any("hunter2" in r["text"] for r in secrets) and len(secrets) == len(passages)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in secrets}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    facts = lambda rows: sorted(((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows), key=repr)
    assert facts(whole) == facts(packed) and len({r["sequence_id"] for r in whole}) == len({r["sequence_id"] for r in packed})


def rows_of(rows):
    return [dict(zip(("doc_id", "text"), r[:2], strict=True)) for r in rows]


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []


def test_near_dedup_keeps_rows_not_ids(spark):
    r = random.Random(8)
    prose = lambda: " ".join("".join(r.choice(SYLLABLES["xx"]) for _ in range(r.randint(1, 4))) for _ in range(90))
    a, b, c, d, e, f = (prose() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (1, e), (2, e), (2, f), (None, f), (9, a)]
    docs = spark.createDataFrame([(k, t, "xx", "s", len(t)) for k, t in rows], SCHEMA)
    want = sorted([(9, a), (None, b), (5, c), (5, d), (1, e), (2, f)], key=repr)
    for n in (1, 3):
        got = corpus_pipeline.near_dedup(spark, docs.repartition(n), "").select("doc_id", "text").collect()
        assert sorted(map(tuple, got), key=repr) == want

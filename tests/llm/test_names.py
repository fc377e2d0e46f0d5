"""Columns that are called like the temporary ones of operators and stages, and rows that repeat."""

import pytest
from pyspark.sql import functions as F

from quillstone.llm import ann, lm_scoring, secrets, simhash
from quillstone.llm.queries import byte_ranks

ODD = ["_row", "fp", "secrets", "_secrets", "c0", "c1", "c9", "_lm_row", "_lm_word", "word", "n", "component", "least", "lang_pred", "a.b"]
TEXTS = ["one two three four five six seven", 'a token = "1eb9c654e721b4f812088970e66a6345"', None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return rows.select(*[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in ODD], "doc_id", "text", F.length("text").alias("n_chars"))


def kept(df):
    return all(r[c] == f"{c}-{r['doc_id']}" for r in df.collect() for c in ODD)


def test_one_of_each_keeps_columns(spark, docs):
    out = simhash.one_of_each(docs.unionByName(docs))
    # a null text and an empty one share a fingerprint
    assert out.columns == docs.columns and kept(out) and sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2]


def test_secrets_keep_columns(spark, docs):
    out = secrets.without_secrets(docs, *byte_ranks())
    assert out.columns == docs.columns and kept(out)
    got = {r["doc_id"]: r for r in out.collect()}
    assert "[secret]" in got[1]["text"] and got[1]["n_chars"] == len(got[1]["text"]) and [got[k]["text"] for k in (0, 2, 3)] == [TEXTS[0], None, ""]


def test_scores_keep_columns(spark, docs):
    out = lm_scoring.score_documents(docs, docs.select("text"))
    assert kept(out) and {r["n_tokens"] for r in out.collect()} == {8, 5, 1}


def test_neighbours_count_rows(spark):
    rows = [(1, [1.0, 0.1]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [5.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id = 1"), k=5).collect()
    # either row of (1, [1, 0.1]) has the other one, and all have the row of that id with another vector
    by = {}
    for r in got:
        by.setdefault((r["query_id"], round(r["score"], 6), r["vec_id"]), 0)
        by[r["query_id"], round(r["score"], 6), r["vec_id"]] += 1
    near, far = round(1 / 1.01**0.5, 6), round(0.1 / 1.01**0.5, 6)
    assert by == {(1, 1.0, 1): 2, (1, near, 2): 2, (1, far, 1): 4, (1, 0.0, 2): 1}


def test_neighbours_of_other_ids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "vec_id string, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id = 'a'"), k=1).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [("a", 1, "b")]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []

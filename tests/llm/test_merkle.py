"""Merkle manifests against trees made in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import merkle, numbering

SCHEMA = "doc_id bigint, lang string, text string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, at, fanout):
    found = []
    for level in tree[:-1]:
        run = at - at % fanout
        found += [level[k] for k in range(run, min(run + fanout, len(level))) if k != at]
        at //= fanout
    return found


def expected(rows, fanout):
    """(doc_id, leaf, subroot, root, proof digest) of rows (doc_id, lang, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r[0]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(by[g], key=lambda x: x[:3])], fanout) for g in langs}
    top = levels([trees[g][-1][0] for g in langs], fanout)
    return sorted(
        ((x[3], x[2], trees[g][-1][0], top[-1][0], H("".join(siblings(trees[g], k, fanout) + siblings(top, langs.index(g), fanout)))) for g in langs for k, x in enumerate(sorted(by[g], key=lambda x: x[:3]))),
        key=repr,
    )


def shown(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest()).collect()), key=repr)


def with_leaf(df):
    return df.withColumn("leaf", merkle.leaf("doc_id", "lang", "text"))


ROWS = [(k, random.Random(k).choice(["en", "en", "en", "de", None, "é", "z"]), "ä" * (k % 5)) for k in range(70)]
ROWS += [(70, "alone", "x"), (None, "en", None), (3, "en", "again"), (3, "en", "again"), (None, None, ""), (None, "en", None)]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest(spark, fanout):
    df = with_leaf(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    got = merkle.manifest(df, "lang", "doc_id", fanout)
    assert shown(got) == expected(ROWS, fanout)
    assert got.filter(merkle.folded("leaf") == F.col("root")).count() == len(ROWS)
    assert got.filter(merkle.folded(merkle.digest("leaf")) == F.col("root")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_few_leaves(spark, n):
    rows = [(k, "en", "t") for k in range(n)]
    assert shown(merkle.manifest(with_leaf(spark.createDataFrame(rows, SCHEMA)), "lang", "doc_id")) == expected(rows, 2)


def test_empty_table(spark):
    got = merkle.manifest(with_leaf(spark.createDataFrame([], SCHEMA)), "lang", "doc_id")
    assert got.collect() == [] and {"leaf", "subroot", "root", "steps"} <= set(got.columns)


def test_columns_of_other_names_stay(spark):
    rows = [(1, "a", "t"), (2, "b", "u"), (3, "b", "w" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.concat("text", F.lit(c)).alias(c) for c in ("g", "h", "at", "n", "row", "kids", "o", "level", "_copy", "_place", "steps", "a.b")])
    got = merkle.manifest(with_leaf(df), "lang", "doc_id")
    assert shown(got) == expected(rows, 2)
    for r in got.collect():
        assert all(r[c] == r["text"] + c for c in ("g", "h", "at", "n", "row", "kids", "o", "level", "_copy", "_place", "a.b"))


def test_a_fanout_of_one_is_refused(spark):
    with pytest.raises(ValueError):
        merkle.manifest(with_leaf(spark.createDataFrame([(1, "a", "t")], SCHEMA)), "lang", "doc_id", 1)


def test_numbers_of_a_group_that_spans_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 601).alias("o"), "id").repartition(5)
    got = numbering.numbered(df, "g", ["o"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["at"])
        assert [r["at"] for r in rows] == list(range(len(rows))) and {r["n"] for r in rows} == {len(rows)}
        assert [r["o"] for r in rows] == sorted(r["o"] for r in rows)

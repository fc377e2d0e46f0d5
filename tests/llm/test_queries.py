"""The registered queries on the smallest tables: one row for each row asked for, and the splits that the contracts name."""

import zlib

import pyarrow.parquet as pq
import pytest

from quillstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows(table, *columns):
    return pq.read_table(f"{SF}/{table}.parquet", columns=list(columns)).to_pylist()


@pytest.mark.parametrize("name", ["op1_language_id", "op4_lm_scoring"])
def test_splits(spark, name):
    mod, held = {"op1_language_id": (4, 2), "op4_lm_scoring": (5, 1)}[name]
    got = {r["doc_id"]: r["held_out"] for r in QUERIES[name](spark, SF).collect()}
    assert got == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % mod == held for r in rows("documents", "doc_id")}


@pytest.mark.parametrize("name", ["op2_secret_scan", "op5_sentence_pieces", "op9_suffix_dedup", "op10_simhash_near_dedup"])
def test_one_row_a_document(spark, name):
    got = QUERIES[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows("documents", "doc_id"))
    if name == "op9_suffix_dedup":
        size = {r["doc_id"]: len((r["text"] or "").encode()) for r in rows("documents", "doc_id", "text")}
        assert all(r["n_bytes"] == size[r["doc_id"]] and 0 <= r["n_removed"] <= r["n_bytes"] for r in got)
    if name == "op5_sentence_pieces":
        assert all(r["round_trip"] for r in got)


def test_pages_vectors_and_packing(spark):
    assert sorted(r["page_id"] for r in QUERIES["op3_warc_segments"](spark, SF).collect()) == sorted(r["page_id"] for r in rows("pages", "page_id"))
    ids = [r["vec_id"] for r in rows("embeddings", "vec_id")]
    assert sorted(r["vec_id"] for r in QUERIES["op8_binary_codes"](spark, SF).collect()) == sorted(ids)
    near = QUERIES["op6_permutation_index"](spark, SF).collect()
    assert {r["query_id"] for r in near} == {i for i in ids if i % 50 == 0} and all(1 <= r["rank"] <= 5 and r["vec_id"] != r["query_id"] for r in near)
    places = {}
    for r in QUERIES["op7_best_fit_packing"](spark, SF).collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048

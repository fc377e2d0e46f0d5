"""The queries of this subpackage: each operator, with production parameters, on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, binary_codes, conversations, langid, lm_scoring, merkle, packing, quality, secrets, sentence_pieces, simhash, sql, suffix_dedup, warc
from .common import hold, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_spec() -> str:
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def byte_ranks() -> tuple[bytes, str]:
    import public_tokenizers

    with open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = hold(docs, "doc_id", 4) == 2
    models = langid.train(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), models).drop("text")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.find_secrets(docs, *byte_ranks()))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = hold(docs, "doc_id", 5) == 1
    return lm_scoring.score_documents(docs.withColumn("held_out", held_out), docs.filter(~held_out))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), f.read())


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_spec())


def op8_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.near_links(table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_texts(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = hold(docs, "doc_id", 5) == 0
    model = quality.train(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.reports(conversations.damaged(rows), rows)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf = merkle.leaf("doc_id", "source", "lang", "n_chars", "text")
    claimed = F.when(tampered, merkle.leaf("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    tree = merkle.manifest(docs.select("doc_id", "lang", leaf.alias("leaf"), F.unhex(claimed).alias("claimed")), "lang", "doc_id")
    shown = tree.withColumn("folded_root", merkle.folded(F.coalesce(merkle.text_of("claimed"), F.col("leaf"))))
    return shown.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_secret_scan, op3_warc_segments, op4_lm_scoring, op5_sentence_pieces,
        op6_permutation_index, op7_best_fit_packing, op8_binary_codes, op9_suffix_dedup, op10_simhash_near_dedup,
        op11_line_quality, op12_conversation_repair, op13_merkle_manifest,
    )
}

#: The others can't be said in DuckDB's SQL: see the tests against brute force.
ORACLE_SQL: dict[str, str] = {"op12_conversation_repair": sql.CONVERSATIONS, "op13_merkle_manifest": sql.MERKLE}

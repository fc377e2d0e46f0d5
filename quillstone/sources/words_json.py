"""Word pages and total sheets as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "doc_id string, tool string, sha256 string, pages array<struct<index:int,width:double,height:double,words:array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>>>"
COMPACT_SCHEMA = "width int, height int, words array<array<string>>"


def read_word_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, pass_id (the tool), page_index, page_width, page_height, word_no, text, x0, x1, top, bottom in thousandths
    of a point, from files <doc>.<tool>-words.json. Words without text, or with white space, are left out; a file that is no
    such JSON gives no rows."""
    files = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r"([^/]+)\.([^/.]+)-words\.json$", 1)
    page = files.select(F.coalesce("doc_id", name).alias("doc_id"), F.coalesce("tool", F.regexp_extract("file", r"\.([^/.]+)-words\.json$", 1)).alias("pass_id"), F.explode("pages").alias("p"))
    word = page.select("doc_id", "pass_id", F.col("p.index").alias("page_index"), "p.width", "p.height", F.posexplode("p.words").alias("word_no", "w"))
    milli = lambda c: F.round(c * 1000).cast("int")
    kept = word.filter((F.length("w.text") > 0) & ~F.col("w.text").rlike(r"\s"))
    return kept.select("doc_id", "pass_id", "page_index", milli(F.col("width")).alias("page_width"), milli(F.col("height")).alias("page_height"), "word_no", "w.text", *[milli(F.col(f"w.{c}")).alias(c) for c in ("x0", "x1", "top", "bottom")])


def read_compact_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same from files of one page whose words are [text, x0, x1, top, bottom] in thousandths of a point."""
    files = spark.read.schema(COMPACT_SCHEMA).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    word = files.select(F.regexp_extract("file", r"([^/]+?)(\.words)?\.json$", 1).alias("doc_id"), F.lit("page").alias("pass_id"), F.lit(0).alias("page_index"), F.col("width").alias("page_width"), F.col("height").alias("page_height"), F.posexplode("words").alias("word_no", "w"))
    return word.select("doc_id", "pass_id", "page_index", "page_width", "page_height", "word_no", F.col("w")[0].alias("text"), *[F.col("w")[k].try_cast("int").alias(c) for k, c in enumerate(("x0", "x1", "top", "bottom"), 1)])


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, total_cents of CSV sheets with ; or , between fields (whichever the header has more of), decimal commas, and
    a last column that overrides the proposed total where it is filled in."""
    line = spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("line"))
    head = line.filter(F.col("line").startswith("doc_id")).select("file", F.when(F.regexp_count("line", F.lit(";")) >= F.regexp_count("line", F.lit(",")), ";").otherwise(",").alias("sep")).dropDuplicates(["file"])
    names = "doc_id string, proposed string, ok string, total_ok string, actual string"
    body = line.filter(~F.col("line").startswith("doc_id") & (F.length("line") > 0)).join(head, "file")
    cells = lambda sep: F.from_csv("line", names, {"sep": sep})
    row = body.withColumn("r", F.when(F.col("sep") == ";", cells(";")).otherwise(cells(",")))
    amount = F.coalesce(F.nullif(F.trim("r.actual"), F.lit("")), F.col("r.proposed"))
    plain = F.replace(F.regexp_replace(amount, r"[.,](?=.*[.,])|[^0-9.,-]", ""), F.lit(","), F.lit("."))
    return row.select("r.doc_id", F.round(plain.try_cast("decimal(20,4)") * 100).cast("bigint").alias("total_cents"))

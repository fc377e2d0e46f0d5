"""Small files of settings as one-row tables: the country, the destination, and the day it was acknowledged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """text of a file, null if there is none: one row either way."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text")) if there else spark.createDataFrame([(None,)], "text string")


def country(spark: SparkSession, path: str, region: Column | None = None) -> DataFrame:
    """country, refusal: the setting of a file {"countryCode": ...}; without the file, ``region`` of the device.

    A code that isn't two capital letters, or a file that is no object, is refused (``notASetting``) and no country is assumed.
    """
    rows = _whole(spark, path).withColumn("v", F.try_parse_json("text"))
    code = F.try_variant_get("v", "$.countryCode", "string")
    object_ = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    bad = F.col("text").isNotNull() & (~object_ | F.coalesce(~code.rlike("^[A-Z]{2}$"), F.lit(False)))
    first = F.lit(None).cast("string") if region is None else region
    return rows.select(F.when(F.col("text").isNull(), first).when(~bad, code).alias("country"), F.when(bad, "notASetting").alias("refusal"))


def destinations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Destinations of a file with a JSON list of objects of ``schema``; no file, no rows. Entries that are no objects are left out."""
    rows = _whole(spark, path).filter("text is not null")
    each = rows.select(F.explode(F.from_json("text", F.lit(f"array<struct<{schema}>>"))).alias("d"))
    return each.filter("d is not null").select("d.*")


def acknowledged(spark: SparkSession, path: str) -> DataFrame:
    """day of a file {"date": "YYYY-MM-DD"}; null without the file, or if it holds anything else: then it isn't acknowledged."""
    date = F.get_json_object(F.when(F.try_parse_json("text").isNotNull(), F.col("text")), "$.date")
    return _whole(spark, path).select(F.when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(date, "yyyy-MM-dd")).alias("day"))


def typed(text: Column, path: str, kind: str, optional: bool = False) -> Column:
    """struct(value, refusal) of a JSON text's member: ``object`` and ``list`` as JSON, ``identifier`` a string or whole number as text.

    refusal is notJson, missing (unless ``optional``), notAnObject, notAList or notAnIdentifier; refused members have no value.
    """
    root = F.try_parse_json(text)
    member = F.try_variant_get(root, path, "variant")
    shape = F.schema_of_variant(member)
    gone = member.isNull() | (shape == "VOID")
    right = {"object": shape.startswith("OBJECT"), "list": shape.startswith("ARRAY"), "identifier": shape.isin("STRING", "BIGINT")}[kind]
    name = {"object": "notAnObject", "list": "notAList", "identifier": "notAnIdentifier"}[kind]
    refusal = F.when(text.isNull() | root.isNull(), "notJson").when(gone, None if optional else "missing").when(~right, name)
    shown = F.try_variant_get(root, path, "string") if kind == "identifier" else F.to_json(member)
    return F.struct(F.when(refusal.isNull() & ~gone, shown).alias("value"), refusal.alias("refusal"))

"""Captured files: what they are, and intake that verifies what it stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from .image_header import with_header

_EXTENSIONS = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png"}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, length, sha256, kind, width, height, orientation of every file under a folder; kind by its first bytes, sides as stored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = magic_kind(F.col("content"))
    return with_header(files).select(
        F.concat(F.lit("D"), F.substring(F.sha1(name.cast("binary")), 1, 8)).alias("doc_id"), "path", "length", F.sha2("content", 256).alias("sha256"), kind.alias("kind"), "width", "height", "orientation",
    )


def magic_kind(content: Column) -> Column:
    """pdf, png, jpeg or null."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    return F.when(head(5) == "255044462D", "pdf").when(head(8) == "89504E470D0A1A0A", "png").when(head(3) == "FFD8FF", "jpeg")


def media_type(declared: Column, name: Column) -> Column:
    """The declared type if it is known, else by extension, else null."""
    known = F.create_map(*[F.lit(x) for kv in _EXTENSIONS.items() for x in kv])
    return F.coalesce(F.when(declared.isin(*set(_EXTENSIONS.values())), declared), F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))))


def intake(files: DataFrame, path: str) -> DataFrame:
    """Writes binary files (path, content) as Parquet and returns path, sha256, stored_sha256, ok read back from there."""
    files.select("path", "content", F.sha2("content", 256).alias("sha256")).write.mode("append").parquet(path)
    back = files.sparkSession.read.parquet(path)
    stored = F.sha2("content", 256)
    return back.select("path", "sha256", stored.alias("stored_sha256"), (stored == F.col("sha256")).alias("ok"))


def intake_stream(spark: SparkSession, inbox: str, store: str, checkpoint: str) -> StreamingQuery:
    """Takes new files of a folder into ``store`` as a stream: path, name, length, sha256, content; each content once.

    Only files that are new are read and hashed. What a batch has stored is read back and hashed again before the batch
    counts as done; where it differs the batch fails, its rows go with it, and it is taken again. A content that the
    store has is left out, so a batch that runs twice, or a file that comes twice, is there once.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(inbox)

    def take(batch: DataFrame, n: int) -> None:
        new = batch.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), "content")
        first = new.groupBy("sha256").agg(F.min("path").alias("path"))
        new = new.join(first, ["sha256", "path"], "left_semi")
        session = batch.sparkSession
        # a batch writes a folder of its own; what an earlier try of it left is replaced
        have = session.read.schema("sha256 string, batch bigint").parquet(store) if n else None
        if have is not None:
            new = new.join(have.filter(F.col("batch") < n), "sha256", "left_anti")
        where = f"{store}/batch={n}"
        new.write.mode("overwrite").parquet(where)
        back = session.read.parquet(where)
        if back.filter(~F.sha2("content", 256).eqNullSafe(F.col("sha256"))).limit(1).count():
            session.createDataFrame([], back.schema).write.mode("overwrite").parquet(where)
            raise ValueError(f"what batch {n} stored isn't what it took")

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()


def unchanged(before: DataFrame, after: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """key, state of files hashed twice: ``unchanged``, ``changed``, ``gone`` or ``new``."""
    met = before.select(key, F.col(digest).alias("_was"), F.lit(True).alias("_had")).join(after.select(key, F.col(digest).alias("_is"), F.lit(True).alias("_has")), key, "full")
    return met.select(key, F.when(F.col("_has").isNull(), "gone").when(F.col("_had").isNull(), "new").when(F.col("_was").eqNullSafe(F.col("_is")), "unchanged").otherwise("changed").alias("state"))


def shown_size(orientation: Column, width: Column, height: Column) -> Column:
    """struct(width, height) as displayed: orientations 5 to 8 swap the sides."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def routes_without(state: Column) -> Column:
    """Whether the original may be deleted: only once its document is sent."""
    return state == "sent"

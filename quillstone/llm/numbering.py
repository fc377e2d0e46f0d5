"""Row numbers within groups of any size: a group that holds a third of all rows is numbered by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stash


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at`` (from 0, within the rows of equal ``group``, in ``order``, nulls first) and ``n`` (rows of the group).

    ``group`` has no nulls, and ``rows`` no columns named at, n, _copy or _place. Rows that tie in ``order`` follow one
    another in the order in which they are read. Rows are dealt out by ranges of (group, order), so that a large group
    spans many partitions; each partition counts its rows, and the counts alone are summed up over partitions. What is
    dealt is written first, as ranges differ from run to run.
    """
    keys = [group, *order, "_copy"]
    dealt = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    # the partition in the upper bits, the row of the partition in the lower 33
    held = stash(dealt.drop("_copy").withColumn("_place", F.monotonically_increasing_id()).withColumn("_block", F.shiftright("_place", 33)))
    blocks = held.groupBy(group, "_block").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    w = Window.partitionBy(group).orderBy("_block")
    blocks = blocks.withColumn("_before", F.sum("_rows").over(w) - F.col("_rows")).withColumn("n", F.sum("_rows").over(Window.partitionBy(group)))
    met = held.join(blocks, [group, "_block"])
    return met.withColumn("at", F.col("_before") + F.col("_place") - F.col("_first")).drop("_block", "_place", "_rows", "_first", "_before")

"""What a loader writes of a document that was read loosely, and the log of what it wrote, rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Years that a document's date may lie in, and dates in file names: year first, day first, day first with a short year.
YEARS = (2000, 2030)
_NAMES = [(r"(20\d{2})-(\d{2})-(\d{2})", ("{0}", "{1}", "{2}")), (r"\b(\d{2})[/.-](\d{2})[/.-](\d{4})\b", ("{2}", "{1}", "{0}")), (r"\b(\d{2})[/.-](\d{2})[/.-](\d{2})\b", ("20{2}", "{1}", "{0}"))]


def decide_day(day: Column, file_name: Column, names_count: bool = False) -> Column:
    """A document's date if its year is plausible. With ``names_count`` a date in the file's name stands in for a missing one.

    A name says when a file was made, not when a document is from, so it doesn't count unless it is asked for.
    """
    plausible = lambda d: F.when(F.year(d).between(*YEARS), d)
    found = [plausible(day)]
    for pattern, places in _NAMES if names_count else []:
        parts = [F.regexp_extract(file_name, pattern, k) for k in (1, 2, 3)]
        y, m, d = (F.concat(F.lit(p.split("{")[0]), parts[int(p[-2])]) for p in places)
        found.append(plausible(F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")))
    return F.coalesce(*found)


def decide_amounts(net: Column, tax: Column, gross: Column, rate: Column, untaxed: Column) -> Column:
    """struct(base, tax) to be written: what was read, else what follows from total and rate, else the total as the base, else zeros.

    A document that bears no tax by its nature (``untaxed``) writes its total as the base. Amounts are doubles of two decimals.
    """
    by_rate = F.when((rate > 0) & gross.isNotNull(), F.round(gross / (1 + rate / 100), 2))
    base = F.coalesce(net, by_rate)
    rest = F.coalesce(tax, F.when(base.isNotNull() & gross.isNotNull(), F.round(gross - base, 2)))
    own = F.struct(base.alias("base"), rest.alias("tax"))
    said = lambda b, t: F.struct(b.cast("double").alias("base"), t.cast("double").alias("tax"))
    return F.when(untaxed, said(F.coalesce(gross, F.lit(0.0)), F.lit(0.0))).when(base.isNotNull(), own).when(gross.isNotNull(), said(gross, F.lit(0.0))).otherwise(said(F.lit(0.0), F.lit(0.0)))


def rebuilt_log(parsed: DataFrame, keys: DataFrame, stored: DataFrame, files: DataFrame, key: str, record: str, name: str) -> DataFrame:
    """``parsed`` with its record by the map ``keys`` (key, record), the columns of ``stored`` by record, and ``files``: names attached to it.

    Every parsed document has a row; one that the map doesn't name has no record. The order of documents says nothing about
    that of records, so only the map joins them.
    """
    attached = files.groupBy(record).agg(F.array_sort(F.collect_set(name)).alias("files"))
    met = parsed.join(keys.select(key, record).dropDuplicates([key]), key, "left").join(stored, record, "left").join(attached, record, "left")
    return met.withColumn("files", F.coalesce("files", F.array().cast("array<string>")))

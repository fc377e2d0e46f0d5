"""Agreement of passes and fidelity by levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import word_normalised


def pass_agreement(words: DataFrame, doc: str = "doc_id", pass_id: str = "pass_id", text: str = "text") -> DataFrame:
    """doc, pass_1, pass_2, shared, larger for every two passes of a document: the size of the intersection of their
    bags of normalised words, and the size of the larger bag. Empty words are left out."""
    n = words.select(doc, pass_id, word_normalised(F.col(text)).alias("w")).filter("w <> ''").groupBy(doc, pass_id, "w").agg(F.count("*").alias("n"))
    size = n.groupBy(doc, pass_id).agg(F.sum("n").alias("size"))
    pair = lambda df, *extra: (df.select(doc, F.col(pass_id).alias("pass_1"), *[F.col(c).alias(f"{c}_1") for c in extra]), df.select(doc, F.col(pass_id).alias("pass_2"), *[F.col(c).alias(f"{c}_2") for c in extra]))
    a, b = pair(size, "size")
    pairs = a.join(b, doc).filter("pass_1 < pass_2").select(doc, "pass_1", "pass_2", F.greatest("size_1", "size_2").alias("larger"))
    x, y = pair(n, "w", "n")
    both = x.join(y, (x[doc] == y[doc]) & (x["w_1"] == y["w_2"]) & (x["pass_1"] < y["pass_2"])).select(x[doc], "pass_1", "pass_2", F.least("n_1", "n_2").alias("k"))
    shared = both.groupBy(doc, "pass_1", "pass_2").agg(F.sum("k").alias("shared"))
    return pairs.join(shared, [doc, "pass_1", "pass_2"], "left").select(doc, "pass_1", "pass_2", F.coalesce("shared", F.lit(0)).alias("shared"), "larger")


def by_levels(rows: DataFrame, levels: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """Measures for each of several groupings in one pass: columns of all levels, null where a level leaves one out."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in level] for level in levels]
    return rows.groupingSets(sets, *[F.col(c) for c in columns]).agg(*[m.alias(name) for name, m in measures.items()])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes given by x0, x1, top, bottom."""
    width = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0)).cast("double")
    height = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0)).cast("double")
    area = lambda x: (x["x1"] - x["x0"]).cast("double") * (x["bottom"] - x["top"])
    return F.try_divide(width * height, area(a) + area(b) - width * height)


def segmentation(words: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, tokens, whitespace_share, median_length of words."""
    plain = words.groupBy(*by).agg(F.count("*").alias("tokens"), F.avg(F.col(text).rlike(r"\s").cast("int")).alias("whitespace_share"))
    middle = median_of(words.withColumn("_length", F.length(text)), "_length", by).withColumnRenamed("median", "median_length")
    return plain.join(middle, by, "left")


def product_metrics(docs: DataFrame, touched: Column, green: Column, abstained: Column, taps: Column) -> DataFrame:
    """documents, untouched, green, abstained (shares) and taps (median) over all documents.

    The shares are one aggregation. For the median values are counted first, and only each distinct value and its count
    are sorted, so no task sees the documents.
    """
    share = lambda c: F.avg(c.cast("int"))
    shares = docs.agg(F.count("*").alias("documents"), share(~touched).alias("untouched"), share(green).alias("green"), share(abstained).alias("abstained"))
    return shares.join(median_of(docs.select(taps.alias("v")), "v").withColumnRenamed("median", "taps"), F.lit(True), "left")


def median_of(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, median of the non-null values: the middle one of their counts added up in order, or the mean of the two middle ones."""
    by = by or []
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    placed = counts.withColumn("_to", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    low, high = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    holds = lambda at: (F.col("_to") - F.col("_n") < at) & (at <= F.col("_to"))
    middle = placed.filter(holds(low) | holds(high))
    lowest, highest = F.min(value), F.max(value)
    return middle.groupBy(*by).agg(((lowest.cast("double") + highest.cast("double")) / 2).alias("median"))


def contrast(stored: DataFrame, formula: DataFrame, key: str, value: str, computed: str) -> DataFrame:
    """key, differs: whether a stored total differs from what the destination's formula made of it."""
    return stored.join(formula, key).select(key, (F.col(value) != F.col(computed)).alias("differs"))


def probe_outcomes(occurrences: DataFrame, totals: DataFrame, doc: str, cents: str, confirmed: str) -> DataFrame:
    """doc, outcome, occurrences, bound of a probe of total labels: ``occurrences`` has a row a label, with the cents it is bound to or null.

    ``yes`` if a label is bound to the confirmed total, ``no`` if none is, ``no label found``, or ``not probed`` where no
    total is confirmed.
    """
    known = totals.select(doc, confirmed)
    met = occurrences.select(doc, F.col(cents).alias("_cents")).join(known, doc)
    counted = met.groupBy(doc).agg(F.count("*").alias("_n"), F.count_if(F.col("_cents") == F.col(confirmed)).alias("_hit"))
    rows = known.join(counted, doc, "left")
    n, hit = (F.when(F.col(confirmed).isNotNull(), F.coalesce(c, F.lit(0))).otherwise(0) for c in ("_n", "_hit"))
    outcome = F.when(F.col(confirmed).isNull(), "not probed").when(n == 0, "no label found").when(hit > 0, "yes").otherwise("no")
    return rows.select(doc, outcome.alias("outcome"), n.alias("occurrences"), hit.alias("bound"))


def page_sizes(pages: DataFrame, by: list[str], width: str = "width", height: str = "height") -> DataFrame:
    """by, sizes: how many different page sizes there are."""
    return pages.groupBy(*by).agg(F.count_distinct(F.struct(width, height)).alias("sizes"))


def seconds_each(events: DataFrame, doc: str, at: str) -> DataFrame:
    """doc, seconds from a document's first event to its last."""
    return events.groupBy(doc).agg((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))).alias("_micros")).select(doc, (F.col("_micros") / 1_000_000).alias("seconds"))


def report_lines(stats: DataFrame, order: list[str]) -> DataFrame:
    """line_no, line: a small table of aggregates as a Markdown table, numbers with two decimals, rows by ``order``, nulls first."""
    cells = [F.coalesce(F.format_string("%.2f", F.col(n)) if t == "double" else F.col(n).cast("string"), F.lit("")) for n, t in stats.dtypes]
    line = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    rows = stats.select((F.row_number().over(Window.orderBy(*order)) + 2).cast("bigint").alias("line_no"), line(cells).alias("line"))
    head = stats.sparkSession.createDataFrame([(1, f"| {' | '.join(stats.columns)} |"), (2, f"| {' | '.join('---' for _ in stats.columns)} |")], "line_no bigint, line string")
    return head.unionByName(rows)

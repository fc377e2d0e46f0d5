"""Stored entries: revisions, journals, listings, duplicates' flags, and readings reconciled over pages and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepted_writes(writes: DataFrame, key: str, order: list[str], revision: str = "revision") -> DataFrame:
    """``writes`` with accepted: whether a write's revision is above every earlier one of its entry.

    A refused write is not above the stored revision, so the greatest of all earlier ones is the stored one.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return writes.withColumn("accepted", F.col(revision) > F.coalesce(F.max(revision).over(w), F.lit(0)))


def latest(writes: DataFrame, key: str, order: list[str], revision: str = "revision") -> DataFrame:
    """key and the stored entry of each: of the greatest revision the first that was written, by ``order`` of any type.

    Two minima and maxima with partial sums: the greatest revision, then the first of its writes. Null revisions are none.
    """
    most = writes.groupBy(F.col(key).alias("_k")).agg(F.max(revision).alias("_most"))
    top = writes.join(most, F.col(key).eqNullSafe(F.col("_k")) & (F.col(revision) == F.col("_most"))).drop("_k", "_most")
    return top.groupBy(key).agg(F.min_by(F.struct(*[c for c in writes.columns if c != key]), F.struct(*order)).alias("e")).select(key, "e.*")


def journal(steps: DataFrame, key: str, order: list[str], step: str) -> DataFrame:
    """key, n, steps: a document's steps in order, joined; a document's own journal is bounded by what it went through."""
    return steps.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, step))), lambda s: s[step]), ">").alias("steps"))


def flag_duplicates(entries: DataFrame, key: str, content: str) -> DataFrame:
    """key, original, duplicate, revision: entries whose content an entry of a smaller key has; null content matches nothing.

    The flag stands beside the state, raises the revision by one and is the same however often it is set. The first
    entry of a content is a minimum with partial aggregation, so a content of very many copies is one row in the join.
    """
    first = entries.filter(F.col(content).isNotNull()).groupBy(content).agg(F.min(key).alias("_first"))
    met = entries.select(key, content).join(first, content, "left")
    dup = F.coalesce(F.col("_first") < F.col(key), F.lit(False))
    return met.select(key, F.when(dup, F.col("_first")).alias("original"), dup.alias("duplicate"), (F.lit(1) + dup.cast("int")).alias("revision"))


def listing(stored: DataFrame, schema: str, key: str, body: str) -> DataFrame:
    """key, readable and the fields of ``schema`` of stored JSON texts; unreadable entries are reported, not fatal."""
    read = F.from_json(body, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = stored.select(key, read.alias("r"))
    names = [c.split()[0] for c in schema.split(", ")]
    good = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return out.select(key, good.alias("readable"), *[F.when(good, F.col(f"r.{c}")).alias(c) for c in names])


def places(entries: DataFrame, by: str, key: str, at: str) -> DataFrame:
    """``entries`` with newest (place in the history, newest first) and oldest (place in the queue); ties by key in both."""
    w = Window.partitionBy(by)
    return entries.withColumn("newest", F.row_number().over(w.orderBy(F.desc(at), key))).withColumn("oldest", F.row_number().over(w.orderBy(at, key)))


def page_readings(bound: DataFrame, doc: str, page: str, seq: str, same_line: str, value: str) -> DataFrame:
    """doc, value, pages: the first binding of each page, one on the label's line before others, if all pages agree."""
    first = bound.groupBy(doc, page).agg(F.min_by(value, F.struct(~F.col(same_line), F.col(seq), F.col(value))).alias("v"))
    return first.groupBy(doc).agg(F.when(F.min("v") == F.max("v"), F.min("v")).alias(value), F.count("*").alias("pages"))


def page_text(rows: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, text: texts of a document's pages in order, one blank line between them."""
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda s: s[text]), "\n").alias(text))


def best_of(rows: DataFrame, key: str, order: list[Column], value: str, most: int) -> DataFrame:
    """key, best: the first ``most`` values of each key by ``order``; ranks stop there, so no group is gathered whole."""
    w = Window.partitionBy(key).orderBy(*order)
    top = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias("best"))


def ordered_pages(pages: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """keys, pages: a pass's pages in the order of their index, ties by value; a pass is bounded by its document."""
    return pages.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda p: p[value]).alias("pages"))


def pages_of_both(reference: DataFrame, candidate: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, page of every page that either side has, once each."""
    return reference.select(doc, page).unionByName(candidate.select(doc, page)).distinct()


def stage_counts(trace: DataFrame, field: str = "field", stage: str = "stage") -> DataFrame:
    """field, stage, n: how often each stage was reached, with subtotals by field and in all."""
    return trace.rollup(field, stage).agg(F.count("*").alias("n"))


def state_summary(docs: DataFrame, fields: list[str], key: str) -> DataFrame:
    """field, state, n over all documents: one column for each field becomes one row."""
    return docs.unpivot([key], fields, "field", "state").groupBy("field", "state").agg(F.count("*").alias("n"))


def surcharges(terms: DataFrame, figures: DataFrame, key: str, radius: int) -> DataFrame:
    """key, term_no, hint, figure_no, value: the figure nearest each hinted term, on its line or within ``radius``.

    ``terms`` has key, term_no, hint, line_no and a box; ``figures`` key, figure_no, value, line_no and a box. Of equally near
    figures the first counts; a figure that several terms take goes to the first of them, and the others take nothing.
    """
    box = ("x0", "x1", "top", "bottom")
    f = figures.select(key, "figure_no", "value", F.col("line_no").alias("_line"), *[F.col(c).alias(f"_{c}") for c in box])
    met = terms.filter("hint is not null").join(f, key)
    apart = lambda a, b: F.greatest(F.greatest(F.col(a), F.col(f"_{a}")) - F.least(F.col(b), F.col(f"_{b}")), F.lit(0)).cast("bigint")
    far = apart("x0", "x1") * apart("x0", "x1") + apart("top", "bottom") * apart("top", "bottom")
    near = met.withColumn("_far", far).filter((F.col("line_no") == F.col("_line")) | (F.col("_far") <= radius * radius))
    best = near.groupBy(key, "term_no", "hint").agg(F.min_by(F.struct("figure_no", "value"), F.struct("_far", "figure_no")).alias("b")).select(key, "term_no", "hint", "b.*")
    return best.groupBy(key, "figure_no").agg(F.min_by(F.struct("term_no", "hint", "value"), "term_no").alias("t")).select(key, "t.term_no", "t.hint", "figure_no", "t.value")


def only_amount(money: Column) -> Column:
    """Aggregate: the single amount of a document, else null."""
    return F.when(F.count(money) == 1, F.min(money))


def attachments(parts: DataFrame, container: str, part: str, size: str, least: int) -> DataFrame:
    """container, choice, among: its largest attachment of at least ``least``; several of one size are for a person to choose from."""
    top = parts.filter(F.col(size) >= least).groupBy(container, size).agg(F.collect_set(part).alias("_p")).groupBy(container).agg(F.max_by("_p", size).alias("_p"))
    return top.select(container, F.when(F.size("_p") == 1, F.get("_p", F.lit(0))).alias("choice"), F.size("_p").alias("among"))


def supplier_memory(reviews: DataFrame, tax_id: str, valid: Column, name: str, learned: Column, at: list[str]) -> DataFrame:
    """tax_id, name: the latest typed or corrected name of each identifier whose check digit holds."""
    return reviews.filter(valid & learned).groupBy(tax_id).agg(F.max_by(name, F.struct(*at)).alias(name))


def missing_both_ways(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, missing: keys that only one side has, and which side lacks them."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.exceptAll(b).withColumn("missing", F.lit("found")).unionByName(b.exceptAll(a).withColumn("missing", F.lit("expected")))

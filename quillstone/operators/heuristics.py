"""Lenient readers and summaries: lookahead, majorities, outliers, best passes, scripted sends, boards, repairs of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .links import union_find


def lookahead(lines: DataFrame, doc: str, order: str, label: Column, amount: Column, reach: int = 3) -> DataFrame:
    """``lines`` that are labels, with ``value``: their own amount, else the first of the next lines, up to ``reach`` and
    before the next label."""
    w = Window.partitionBy(doc).orderBy(order)
    ahead = w.rowsBetween(1, reach)
    marked = lines.withColumn("_label", label).withColumn("_amount", amount).withColumn("_n", F.row_number().over(w))
    near = F.first(F.when(F.col("_amount").isNotNull(), F.struct("_n", "_amount")), ignorenulls=True).over(ahead)
    barrier = F.min(F.when(F.col("_label"), F.col("_n"))).over(ahead)
    found = marked.withColumn("_near", near).withColumn("_barrier", barrier).filter("_label")
    borrowed = F.when(F.col("_barrier").isNull() | (F.col("_near._n") < F.col("_barrier")), F.col("_near._amount"))
    return found.withColumn("value", F.coalesce("_amount", borrowed)).drop("_label", "_amount", "_n", "_near", "_barrier")


def majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, value, votes: the most frequent value of a group, the first seen of equals."""
    votes = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    top = F.min_by(F.struct(value, "votes"), F.struct(F.negative("votes"), "_first", value))
    return votes.groupBy(*keys).agg(top.alias("t")).select(*keys, "t.*")


def plurality(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, value, votes, of (all votes), unanimous and runners_up: the most frequent value of a group and the next two
    with their votes, the first seen of equals before the others."""
    votes = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    w = Window.partitionBy(*keys)
    ranked = votes.withColumn("of", F.sum("votes").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("votes"), "_first", value))).filter("_n <= 3")
    top = ranked.groupBy(*keys).agg(F.first("of").alias("of"), F.sort_array(F.collect_list(F.struct("_n", value, "votes"))).alias("_top"))
    bare = F.transform(F.slice("_top", 2, 2), lambda x: F.struct(x[value].alias(value), x["votes"].alias("votes")))
    first = F.col("_top")[0]
    return top.select(*keys, first[value].alias(value), first["votes"].alias("votes"), "of", (first["votes"] == F.col("of")).alias("unanimous"), bare.alias("runners_up"))


def without_outliers(amounts: DataFrame, key: str, value: str, times: float = 50.0) -> DataFrame:
    """key, median, largest: the largest amount of at most ``times`` the lower median of the group's amounts.

    The group is read twice by hash aggregation; the median is an exact order statistic.
    """
    mid = amounts.groupBy(key).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median"))
    return amounts.join(mid, key).filter(F.col(value) <= times * F.col("median")).groupBy(key).agg(F.first("median").alias("median"), F.max(value).alias("largest"))


def best_pass(passes: DataFrame, key: str, pass_id: str, text: str) -> DataFrame:
    """key, pass_id, words: the pass with most words of three letters or more, the first of equals."""
    n = F.size(F.regexp_extract_all(text, F.lit(r"(\p{L}{3,})"), 1))
    return passes.withColumn("words", n).groupBy(key).agg(F.min_by(F.struct(pass_id, "words"), F.struct(F.negative("words"), pass_id)).alias("b")).select(key, "b.*")


def scripted_send(attempts: DataFrame, key: str, order: str, status: str, most: int = 4) -> DataFrame:
    """key, outcome, attempts, waited: a send that retries 429 and 5xx up to ``most`` attempts, 1, 2, 4 seconds apart.

    Attempts beyond the one that ends the send are not made. A document's attempts are a short array, folded in order.
    """
    start = F.struct(F.lit("queued").alias("outcome"), F.lit(0).alias("attempts"), F.lit(0).alias("waited"), F.lit(False).alias("ended"))

    def step(a, s):
        ok, again = s.between(200, 299), (s == 429) | (s >= 500)
        last = a["attempts"] + 1 >= most
        said = F.when(ok, "sent").when(again & ~last, "queued").otherwise("failed")
        wait = F.when(again & ~last, F.pow(F.lit(2), a["attempts"]).cast("int")).otherwise(0)
        return F.struct(F.when(a["ended"], a["outcome"]).otherwise(said).alias("outcome"), (a["attempts"] + F.when(a["ended"], 0).otherwise(1)).alias("attempts"), (a["waited"] + F.when(a["ended"], 0).otherwise(wait)).alias("waited"), (a["ended"] | ok | ~again | last).alias("ended"))

    rows = attempts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, status))).alias("s"))
    done = rows.withColumn("r", F.aggregate(F.transform("s", lambda x: x[status]), start, step))
    return done.select(key, "r.outcome", "r.attempts", "r.waited")


def board(tasks: DataFrame, by: str, done: Column, late_days: Column) -> DataFrame:
    """by, done, open, late, most_days_late of tasks."""
    late = ~done & (late_days > 0)
    return tasks.groupBy(by).agg(F.count_if(done).alias("done"), F.count_if(~done).alias("open"), F.count_if(late).alias("late"), F.coalesce(F.max(F.when(late, late_days)), F.lit(0)).alias("most_days_late"))


#: The characters that Windows-1252 has where ISO 8859-1 has controls, and those controls.
_SMART = {b: bytes([b]).decode("windows-1252", "ignore") for b in range(0x80, 0xA0)}
SMART = "".join(c for c in _SMART.values() if c)
CONTROLS = "".join(chr(b) for b, c in _SMART.items() if c)


def misread_text(x: Column) -> Column:
    """What UTF-8 looks like when it is read as Windows-1252."""
    return F.translate(F.decode(F.encode(x, "UTF-8"), "ISO-8859-1"), CONTROLS, SMART)


def repaired_text(x: Column) -> Column:
    """UTF-8 that was read as Windows-1252, turned back; the text itself where that is not what happened."""
    plain = F.translate(x, SMART, CONTROLS)
    raw = F.when(plain.rlike(r"^[\x{00}-\x{FF}]*$"), F.encode(F.when(plain.rlike(r"^[\x{00}-\x{FF}]*$"), plain), "ISO-8859-1"))
    return F.coalesce(F.when(x.rlike("[^\\x{00}-\\x{7F}]"), F.try_validate_utf8(raw.cast("string"))), x)


def overlap_lines(words: DataFrame, page: list[str], ratio: float = 0.5) -> DataFrame:
    """page, word_no, line: words in one line are those connected by vertical overlaps of at least ``ratio`` of the smaller
    height; a line is named by its smallest word_no. A page of paper is a group."""
    def lines(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("word_no")
        top, bottom = pdf["top"].to_numpy(), pdf["bottom"].to_numpy()
        overlap = np.minimum(bottom[:, None], bottom) - np.maximum(top[:, None], top)
        least = np.minimum((bottom - top)[:, None], bottom - top)
        i, j = np.nonzero((overlap >= ratio * np.maximum(least, 1)) & (np.arange(len(top))[:, None] < np.arange(len(top))))
        root = union_find(len(top), i, j)
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in page}, "word_no": pdf["word_no"].to_numpy(), "line": pdf["word_no"].to_numpy()[root]})

    schema = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in [*page, "word_no"])
    return words.select(*page, "word_no", "top", "bottom").groupBy(*page).applyInPandas(lines, f"{schema}, line {words.schema['word_no'].dataType.simpleString()}")


def match_words(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, ref_no, cand_no, distance: one-to-one matches of equal words of a page, nearest centres first.

    Both have keys, word_no, text, cx, cy. Words meet by an equality of page and text; the greedy choice runs within the
    words of one text on one page.
    """
    b = candidate.select(*keys, "text", F.col("word_no").alias("cand_no"), F.col("cx").alias("_x"), F.col("cy").alias("_y"))
    met = reference.join(b, [*keys, "text"]).select(*keys, "text", F.col("word_no").alias("ref_no"), "cand_no", F.hypot(F.col("cx") - F.col("_x"), F.col("cy") - F.col("_y")).alias("distance"))

    def greedy(pdf):
        refs, cands, keep = set(), set(), []
        for k, r in enumerate(pdf.sort_values(["distance", "ref_no", "cand_no"]).itertuples(index=False)):
            if r.ref_no not in refs and r.cand_no not in cands:
                refs.add(r.ref_no)
                cands.add(r.cand_no)
                keep.append(r)
        import pandas as pd

        return pd.DataFrame(keep, columns=list(pdf.columns))

    return met.groupBy(*keys, "text").applyInPandas(greedy, met.schema)


def einvoice(invoices: DataFrame, key: str, xml: str) -> DataFrame:
    """key, number, currency, gross (text) of e-invoices; null for what the XML has not, which is a state of its own."""
    read = lambda path: F.nullif(F.xpath_string(xml, F.lit(path)), F.lit(""))
    total = "/Invoice/LegalMonetaryTotal/PayableAmount"
    return invoices.select(key, read("/Invoice/ID").alias("number"), read(f"{total}/@currencyID").alias("currency"), read(total).alias("gross"))

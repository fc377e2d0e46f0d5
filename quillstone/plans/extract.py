"""From positioned words to one record per document: the text route, and votes over passes for recognised documents.

Lines, boxes of labels, figures and operands are written in the shared folder and read back, as several steps read each. The
exchanges are on the document and its pages, and a page is the largest thing that is ever one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import amounts, dates, dims
from quillstone.operators import binding, confidence, consensus, layout, negative, records, solver, terms
from quillstone.sources.shared import stored

PAGE = ["doc_id", "pass_id", "page_index"]
_ROLE = {"total": "gross", "base": "base", "tax": "tax"}


def line_words(lines: DataFrame) -> DataFrame:
    """A row for each word of a line, with its place in the line's text (first_char from 1) and the word after it."""
    each = lines.select(*PAGE, "line_no", F.posexplode("words").alias("nth", "w"), "words")
    before = F.aggregate(F.slice("words", F.lit(1), F.col("nth")), F.lit(1), lambda a, w: a + F.length(w["text"]) + 1)
    after = F.try_element_at("words", F.col("nth") + 2)
    return each.select(*PAGE, "line_no", "nth", "w.*", before.alias("first_char"), after["text"].alias("next_text"), after["x1"].alias("next_x1"))


def matched_boxes(words: DataFrame, matches: DataFrame) -> DataFrame:
    """PAGE, line_no, label_id, term, kind, hint and the box of the words that each match covers."""
    keyed = matches.withColumn("label_id", F.concat_ws("|", "kind", "language", "term", F.col("start").cast("string"), F.col("line_no").cast("string"))).withColumn("stop", F.col("start") + F.length("term"))
    inside = (F.col("first_char") < F.col("stop")) & (F.col("first_char") + F.length("text") > F.col("start"))
    met = keyed.join(words, [*PAGE, "line_no"]).filter(inside)
    return met.groupBy(*PAGE, "line_no", "label_id", "term", "kind", "hint").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def amount_words(words: DataFrame, convention, digits) -> DataFrame:
    """Words, alone or with the next one, that are amounts and no rates; the shorter reading wins."""
    rate = F.col("text").endswith("%") | F.coalesce(F.col("next_text").startswith("%"), F.lit(False))
    alone = amounts.parse_amount(F.col("text"), convention, digits)
    pair = amounts.parse_amount(F.concat_ws(" ", "text", "next_text"), convention, digits)
    value = F.when(~rate, F.coalesce(alone, pair))
    wide = alone.isNull() & pair.isNotNull()
    return words.withColumn("value", value).filter("value is not null").withColumn("x1", F.when(wide, F.col("next_x1")).otherwise(F.col("x1")))


def printed_rates(words: DataFrame) -> DataFrame:
    """doc_id, pass_id, rate_bp of every figure before a per cent sign."""
    glued, apart = F.col("text").endswith("%"), F.coalesce(F.col("next_text").startswith("%"), F.lit(False))
    figure = F.replace(F.regexp_replace("text", "%$", ""), F.lit(","), F.lit("."))
    return words.filter(glued | apart).select("doc_id", "pass_id", amounts.parse_rate(figure).alias("rate_bp")).filter("rate_bp is not null").distinct()


def read_operands(words: DataFrame, term_rows: DataFrame, country: str = "ES", radius: int = negative.RADIUS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operands, rates, suppressed) of word rows (doc_id, pass_id, page_index, word_no, text, x0, x1, top, bottom).

    Operands are doc_id, pass_id, role, minor; suppressed ones stand in negative context, on whichever page, as
    coordinates alone count.
    """
    row = dims.COUNTRIES[country]
    lines = stored(layout.lines(words, PAGE))
    each = line_words(lines)
    found = terms.find_terms(lines, term_rows, [*PAGE, "line_no"])
    boxes = stored(matched_boxes(each, found))
    figures = amount_words(each, F.lit(row["decimal"]), F.lit(dims.CURRENCY_DIGITS[row["currency"]]))
    labels = boxes.filter(F.col("kind").isin(*_ROLE))
    named = figures.withColumn("value", F.struct("value", "x0", "x1", "top", "bottom", F.col("line_no").alias("at_line")))
    bound = binding.bind_labels(labels, named, lines, PAGE, "label_id")
    role = F.create_map(*[F.lit(x) for kv in _ROLE.items() for x in kv])[F.split_part("label_id", F.lit("|"), F.lit(1))]
    operands = bound.select(*PAGE, role.alias("role"), F.col("value.value").alias("minor"), "value.at_line", "value.x0", "value.x1", "value.top", "value.bottom").distinct()
    operands = stored(operands)
    bad = boxes.filter("kind = 'negative'").select(*PAGE, F.col("line_no").alias("at_line"), "x0", "x1", "top", "bottom")
    clear = operands.join(bad.select(*PAGE, "at_line").distinct(), [*PAGE, "at_line"], "left_anti")
    beside = operands.join(bad.select(*PAGE, "at_line").distinct(), [*PAGE, "at_line"], "left_semi")
    kept, gone = negative.split_by_context(clear, bad, ["doc_id", "pass_id"], radius)
    out = ["doc_id", "pass_id", "role", "minor"]
    return kept.select(*out).distinct(), printed_rates(each), gone.select(*out).unionByName(beside.select(*out)).distinct()


def extract(words: DataFrame, term_rows: DataFrame, route: str = "pdf-text", country: str = "ES") -> DataFrame:
    """doc_id, outcome, gross, net, tax, confidence of each, currency, needs_review of every document of ``words``.

    On the text route all candidates go to the solver. On a recognised route each pass first says one value a role or
    none, passes vote, and a role with readings but no majority leaves the breakdown unsolved.
    """
    operands, rates, _ = read_operands(words, term_rows, country)
    legal = dims.legal_rates(words.sparkSession)
    admitted, _ = solver.gate_rates(rates.withColumn("country", F.lit(country)), legal)
    disputed = None
    if route != "pdf-text":
        said = operands.groupBy("doc_id", "pass_id", "role").agg(consensus.unanimous(F.col("minor")).alias("value")).filter("value is not null")
        voted = consensus.consensus(said, ["doc_id", "role"])
        disputed = voted.groupBy("doc_id").agg(F.bool_or(F.col("kind") == "none").alias("disputed"))
        operands = voted.filter("kind <> 'none'").select("doc_id", "role", F.col("value").alias("minor"))
    solved = solver.solve(operands.select("doc_id", "role", "minor").distinct(), admitted)
    docs = words.select("doc_id").distinct().join(solved, "doc_id", "left")
    if disputed is not None:
        docs = docs.join(disputed, "doc_id", "left").withColumn("outcome", F.when(F.coalesce("disputed", F.lit(False)), F.lit("disputed")).otherwise(F.col("outcome"))).drop("disputed")
    check = F.when(F.col("outcome") == "read", "passed").otherwise("none")
    sure = confidence.confidence(F.lit("amount"), check)
    state = lambda c: F.when(F.col(c).isNotNull(), "present").otherwise("absent")
    names = ("gross", "base", "tax")
    review = confidence.needs_review(F.array(*[state(c) for c in names]), F.array(*[sure for _ in names]))
    return docs.select("doc_id", F.coalesce("outcome", F.lit("none")).alias("outcome"), "gross", F.col("base").alias("net"), "tax", *[F.when(F.col(c).isNotNull(), sure).otherwise("red").alias(f"{c}_confidence") for c in names], F.lit(dims.COUNTRIES[country]["currency"]).alias("currency"), review.alias("needs_review"))


def document_dates(words: DataFrame, country: str = "ES") -> DataFrame:
    """doc_id, date: the one date that all of a document's printed dates agree on."""
    shown = words.select("doc_id", dates.parse_date(F.col("text"), F.lit(dims.COUNTRIES[country]["order"])).alias("date"))
    return shown.groupBy("doc_id").agg(consensus.unanimous(F.col("date")).alias("date"))


def merge_second_read(current: DataFrame, fresh: DataFrame, fields: list[str]) -> DataFrame:
    """Fields (structs with state) of a second read over a first: edited ones stay, present new ones win, others stay."""
    new = fresh.select("doc_id", *[F.col(f).alias(f"_{f}") for f in fields])
    pick = lambda f: F.when(F.col(f)["state"] == "edited", F.col(f)).when(F.col(f"_{f}")["state"] == "present", F.col(f"_{f}")).otherwise(F.col(f)).alias(f)
    return current.join(new, "doc_id", "left").select("doc_id", *[pick(f) for f in fields])


def mixed_pages(text_pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """doc_id, page_index, words: pages with a text layer, holes filled from recognition by page, else empty."""
    other = recognised.select("doc_id", "page_index", F.col("words").alias("_words"))
    words = F.when(F.size("words") > 0, F.col("words")).otherwise(F.coalesce("_words", "words"))
    return text_pages.join(other, ["doc_id", "page_index"], "left").select("doc_id", "page_index", words.alias("words"))


def retention(history: DataFrame) -> DataFrame:
    """Originals that may be deleted: those of documents that replay to ``sent``."""
    return records.replay(history, "doc_id", ["seq"]).filter("state = 'sent'").select("doc_id")

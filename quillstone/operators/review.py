"""What a reviewer sees and types, and the guards before a document is taken in or discarded: column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import amounts, dims

# Fields in the order of review.
FIELDS = ["docDate", "supplierName", "supplierTaxId", "docNumber", "grossTotal", "currency"]


def edit(field: Column, typed: Column, currency: Column) -> Column:
    """struct(value, refusal) of a typed text for a field; currency is the document's, null if it has none.

    refusal is notADate, amountNeedsCurrency, notAnAmount, unknownCurrency, or null. Amounts are minor units.
    """
    text = F.trim(typed)
    digits = F.create_map(*[F.lit(x) for kv in dims.CURRENCY_DIGITS.items() for x in kv])
    date = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    amount = amounts.parse_decimal(text, F.try_element_at(digits, currency))
    code = F.upper(text)
    known = F.try_element_at(digits, code).isNotNull()
    value = (
        F.when(field == "docDate", date.cast("string")).when(field == "grossTotal", F.when(currency.isNotNull(), amount).cast("string"))
        .when(field == "currency", F.when(known, code)).otherwise(text)
    )
    refusal = (
        F.when((field == "docDate") & date.isNull(), "notADate").when((field == "grossTotal") & currency.isNull(), "amountNeedsCurrency")
        .when((field == "grossTotal") & amount.isNull(), "notAnAmount").when((field == "currency") & ~known, "unknownCurrency")
    )
    return F.struct(value.alias("value"), refusal.alias("refusal"))


def shown(state: Column, value: Column, confidence: Column, provenance: Column) -> Column:
    """struct(text, colour, edited, source): an absent field is red and has no text; an edited one is green and has no source."""
    there = state != "absent"
    return F.struct(
        F.when(there, value).alias("text"), F.when(~there, "red").when(state == "edited", "green").otherwise(confidence).alias("colour"),
        (state == "edited").alias("edited"), F.when(state == "present", provenance).alias("source"),
    )


def focus(fields: Column) -> Column:
    """Of an array of struct(no, field, text, colour) the first field without text or in red, by no; else the first."""
    ordered = F.array_sort(fields)
    open_ = F.filter(ordered, lambda x: x["text"].isNull() | (x["colour"] == "red"))
    return F.coalesce(F.get(open_, F.lit(0))["field"], F.get(ordered, F.lit(0))["field"])


def collapsed(colours: Column, base: Column, tax: Column, gross: Column) -> Column:
    """Whether the amounts show as one line: all green, and the breakdown sums."""
    return F.forall(colours, lambda c: c == "green") & F.coalesce(amounts.sums_to(base, tax, gross), F.lit(False))


def choice(option: Column, current: Column) -> Column:
    """Aggregate: the only option, else the current one if it is still listed, else null."""
    return F.when(F.count(option) == 1, F.min(option)).when(F.bool_or(option == current), F.min(current))


def intake_decision(n: Column) -> Column:
    """What a shared batch of n documents leads to."""
    return F.when(n == 0, "refuseNone").when(n == 1, "store").otherwise("refuseSeveral")


def endpoint(url: Column) -> Column:
    """struct(host, port) of an https address without user, path or query; null for any other. The port is 443 by default."""
    shape = r"^https://([A-Za-z0-9][A-Za-z0-9.-]*)(?::([0-9]{1,5}))?/?$"
    port = F.coalesce(F.nullif(F.regexp_extract(url, shape, 2), F.lit("")).cast("int"), F.lit(443))
    return F.when(url.rlike(shape) & port.between(1, 65535), F.struct(F.lower(F.regexp_extract(url, shape, 1)).alias("host"), port.alias("port")))


def may_discard(capture_id: Column) -> Column:
    return F.coalesce(capture_id.rlike("^[0-9a-f]{32}$"), F.lit(False))


def mapped(fields: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """``fields`` with mapped: whether ``mapping`` has the key. One join with the mapping's distinct keys."""
    have = mapping.select(F.col(key).alias("_key")).distinct().withColumn("_have", F.lit(True))
    met = fields.join(have, F.col(key) == F.col("_key"), "left")
    return met.withColumn("mapped", F.coalesce("_have", F.lit(False))).drop("_key", "_have")


def synonyms(fields: DataFrame, terms: DataFrame) -> DataFrame:
    """field, synonym: the label terms of a field's kind, or its own name where the kind has none."""
    found = fields.join(terms.select("kind", "term").distinct(), "kind", "left")
    return found.select("field", F.coalesce("term", "field").alias("synonym")).distinct()


# What a reviewer does in a session.
ACTIONS = ("edit", "unlock", "acknowledge", "reread")


def session(actions: DataFrame, key: str, order: list[str], day: str) -> DataFrame:
    """``actions`` (key, order, action, field, typed, parsed, colour) with accepted and acknowledged.

    A green field takes an edit only after its lock was tapped in the session; a typed text that is refused (``parsed`` null)
    changes nothing. The destination is acknowledged once a calendar day: a further tap on the same day is not accepted.
    ``acknowledged`` tells whether the day of an action had its tap by then. What decides an action are the earlier
    ones of its field or day, so these are windows over a document's field and a document's day.
    """
    by_field = Window.partitionBy(key, "field").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    by_day = Window.partitionBy(key, day).orderBy(*order)
    unlocked = F.coalesce(F.bool_or(F.col("action") == "unlock").over(by_field), F.lit(False))
    before = F.coalesce(F.bool_or(F.col("action") == "acknowledge").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    edits = F.col("parsed").isNotNull() & ((F.col("colour") != "green") | unlocked)
    accepted = F.when(F.col("action") == "edit", edits).when(F.col("action") == "acknowledge", ~before).otherwise(F.lit(True))
    return actions.withColumns({"accepted": F.coalesce(accepted, F.lit(False)), "acknowledged": before | (F.col("action") == "acknowledge")})


def session_values(taken: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, field, state, value of what a session (as :func:`session` makes it) leaves: ``edited`` or ``present``.

    The last accepted edit stays, whatever is read again before or after it; else the last second read that found a value.
    """
    of = lambda action, c: F.when((F.col("action") == action) & F.col("accepted") & F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v")))
    last = taken.groupBy(key, "field").agg(F.max(of("edit", "parsed")).alias("e"), F.max(of("reread", "typed")).alias("r"))
    state = F.when(F.col("e").isNotNull(), "edited").when(F.col("r").isNotNull(), "present").otherwise("absent")
    return last.select(key, "field", state.alias("state"), F.coalesce("e.v", "r.v").alias("value"))

"""Printed amounts and rates as exact integers; every function is a column expression, null where a text is refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amounts in minor units stay within this bound.
BOUND = 10**15
#: What may be an amount: nothing else is taken apart. Possessive, so that a long text is read once.
_FIGURES = r"^ *+-?[0-9., ]++-? *+$"


def amount_convention(printed: Column) -> Column:
    """'comma' or 'dot' where one printed amount decides which is its decimal mark, else null.

    Two different marks with exactly three digits between them decide for the second; a single mark followed by two
    final digits decides for itself.
    """
    text = F.trim(printed)
    text = F.when(text.startswith("-") | text.endswith("-"), F.replace(text, F.lit("-"), F.lit(""))).otherwise(text)
    text = F.replace(text, F.lit(" "), F.lit(""))
    dot, comma = F.instr(text, "."), F.instr(text, ",")
    both = F.when(text.rlike(r"^[^.,]*\.[0-9]{3},"), "comma").when(text.rlike(r"^[^.,]*,[0-9]{3}\."), "dot")
    alone = F.when(text.rlike(r"^[^.,]*,[0-9]{2}$"), "comma").when(text.rlike(r"^[^.,]*\.[0-9]{2}$"), "dot")
    return F.when((dot > 0) & (comma > 0), both).otherwise(alone)


def agreed(evidence: Column) -> Column:
    """Aggregate: the one value that all non-null evidence agrees on, else null."""
    return F.when(F.min(evidence) == F.max(evidence), F.min(evidence))


def parse_amount(printed: Column, convention: Column, digits: Column) -> Column:
    """Minor units of a printed amount, as bigint.

    A '-' before or after makes it negative. Spaces and every grouping mark are taken out, wherever they stand. More
    decimals than the currency's digits, or over 10**15 minor units, are refused.
    """
    text = F.trim(printed)
    body = F.when(text.startswith("-"), F.substring(text, 2, 1 << 20)).when(text.endswith("-"), text.substr(F.lit(1), F.length(text) - 1)).otherwise(text)
    negative = text.startswith("-") | text.endswith("-")
    plain = F.when(convention == "comma", F.translate(body, ",. ", ".")).otherwise(F.translate(body, ", ", ""))
    whole = F.split_part(plain, F.lit("."), F.lit(1))
    part = F.split_part(plain, F.lit("."), F.lit(2))
    minor = F.concat(whole, F.rpad(part, digits, "0")).try_cast("decimal(38,0)")
    good = plain.rlike(r"^[0-9]{1,20}(\.[0-9]+)?$") & (F.length(part) <= digits) & (minor <= BOUND) & convention.isin("comma", "dot")
    return F.when(printed.rlike(_FIGURES), F.when(good, F.when(negative, -minor).otherwise(minor).cast("bigint")))


def format_amount(minor: Column, digits: Column) -> Column:
    """Canonical decimal text of minor units."""
    body = F.lpad(F.abs(minor).cast("string"), F.greatest(F.length(F.abs(minor).cast("string")), digits + 1), F.lit("0"))
    cut = F.length(body) - digits
    text = F.concat(body.substr(F.lit(1), cut), F.when(digits > 0, F.concat(F.lit("."), body.substr(cut + 1, digits))).otherwise(""))
    return F.concat(F.when(minor < 0, "-").otherwise(""), text)


def parse_decimal(text: Column, digits: Column) -> Column:
    """Minor units of a canonical decimal text, the inverse of :func:`format_amount`; anything else is refused.

    A '-' may lead; there are at most ``digits`` decimals, a '.' before them, no grouping, at most BOUND minor units.
    """
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    minor = F.concat(whole, F.rpad(part, digits, "0")).try_cast("decimal(38,0)")
    good = text.rlike(r"^-?[0-9]{1,20}(\.[0-9]+)?$") & (F.length(part) <= digits) & (F.abs(minor) <= BOUND)
    return F.when(good, minor.cast("bigint"))


def plus(a: Column, b: Column, currency_a: Column, currency_b: Column) -> Column:
    """The sum of two amounts of one currency; null for two currencies or beyond BOUND."""
    total = wide(a) + wide(b)
    return F.when((currency_a == currency_b) & (F.abs(total) <= BOUND), total.cast("bigint"))


def compared(a: Column, b: Column, currency_a: Column, currency_b: Column) -> Column:
    """-1, 0 or 1 for two amounts of one currency, else null."""
    return F.when(currency_a == currency_b, F.signum(wide(a) - wide(b)).cast("int"))


def total(minor: Column) -> Column:
    """Aggregate: the sum of amounts, null beyond BOUND."""
    s = F.sum(wide(minor))
    return F.when(F.abs(s) <= BOUND, s.cast("bigint"))


def parse_rate(printed: Column) -> Column:
    """Basis points (0 to 10000) of a printed percentage with at most two decimals."""
    bp = F.round(printed.try_cast("decimal(10,4)") * 100).cast("int")
    return F.when(printed.rlike(r"^[0-9]{1,5}(\.[0-9]{1,2})?$") & (bp <= 10000), bp)


def rate_text(bp: Column) -> Column:
    """A rate in per cent, without needless zeros."""
    return F.regexp_replace((bp / F.lit(100)).cast("decimal(7,2)").cast("string"), r"\.?0+$", "")


def wide(x: Column) -> Column:
    """For products of amounts and rates, which a bigint does not hold."""
    return x.cast("decimal(19,0)")


def tax_within_tolerance(base: Column, tax: Column, rate_bp: Column) -> Column:
    """Whether a tax lies within one minor unit of base times rate, exactly.

    The base is taken apart into ten thousands and a rest, so that every product fits a bigint; a tax that is far off is
    cut to a distance that is too large as well.
    """
    base, tax, rate = (x.cast("bigint") for x in (base, tax, rate_bp))
    rest = base % 10000
    apart = tax - F.call_function("div", base, F.lit(10000)) * rate
    near = F.greatest(F.least(apart, F.lit(100_000)), F.lit(-100_000))
    return F.abs(near * 10000 - rest * rate) <= 10000


def sums_to(base: Column, tax: Column, gross: Column) -> Column:
    return base + tax == gross


def minor_from_double(value: Column, digits: Column) -> Column:
    """Minor units of a float, halves away from zero."""
    scaled = value * F.pow(F.lit(10.0), digits)
    return (F.signum(scaled) * F.floor(F.abs(scaled) + 0.5)).cast("bigint")

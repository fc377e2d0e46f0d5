"""Amounts of plain text: what role each line plays, and a cascade of stages that settles net, tax and total with a method's tag.

A text is one row; lines, figures and candidates are arrays in it, and each stage sees only what the earlier ones left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.once import once
from quillstone.operators.lenient import AMOUNT, last_mark_amount

# Words after which a number is an identifier, and words of lines that hold nothing but metadata.
NUMBERED = ["AUT", "AUTH", "AUTORIZ", "ARC", "AID", "TPV", "TERMINAL", "OPERAC", "TRANSAC", "COMERCIO", "LICENCIA", "MATRICULA", "RUC", "IBAN", "TARJETA", "TEL", "FAX", "OPER", "PAN", "UNL", "STAN", "CADUCIDAD", "TRAFICO"]
METADATA = ["AUT", "AUTH", "AUTORIZ", "ARC", "AID", "TPV", "OPERAC", "TRANSAC", "OPER", "PAN", "UNL", "STAN", "CADUCIDAD", "MATRICULA", "LICENCIA", "IBAN", "RUC", "TERMINAL", "COMERCIO", "TRAFICO", "OPERAD", "ACLA", "AVL"]
# Words of each role as patterns, in the order in which they are looked for.
ROLES = [
    ("net", [r"SUB\s?-?TOTAL"]), ("gross", ["TOTAL", r"A\s+PAGAR", "GESAMT", "SUMME", r"IMPORTE\s+DE\s+FACTURA"]),
    ("net", ["BASE", r"B\.?\s?IMP", "NETO", "NETTO", r"IMPORTE\s+BRUTO", "BRUTO"]), ("tax", ["IVA", "VAT", "CUOTA", "TAX", "IMPUESTO"]),
]
# Currency marks beside amounts, codes alone, and what introduces a rate of exchange.
MARKS, CODES, EXCHANGE = "€|EUR|USD|GBP|MAD|\\$", "EUR|USD|GBP|MAD|CHF|DHS?", "taux|cambio|change|rate|equivalent"
# The largest amount that is taken for one, the share of a typical figure that is plausible, and tolerances.
MOST, TIMES, SUM_ERROR, TAX_ERROR, HIGHEST_RATE = 50_000_000, 50, 0.02, 0.05, 30
#: How many lines below a label its amount may stand.
REACH = 3
_FIGURE = r"\d[\d.,]*(?:\s\d{3})*"
_OPEN, _SHUT, _END = "\x01", "\x02", "\x03"
_METHODS = ("gross", "gross_method", "net", "net_method", "tax", "tax_method", "state")


def _cents(x: Column) -> Column:
    """Two decimals of the float itself, as the prototype's and the SQL's: 17712.135 is a little less than that, and rounds down."""
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def line_figures(line: Column) -> Column:
    """Plausible money of a line, in order: no rates, no parts of dates, no bare numbers of three digits and more, no small counts.

    Figures are marked in the text, so that each is seen with what stands before and after it.
    """
    # a line without digits has no figure
    return F.when(line.rlike(r"\d"), once(F.split(F.regexp_replace(line, f"({_FIGURE})", f"{_OPEN}$1{_SHUT}"), _OPEN, -1), _figures_of)).when(line.isNotNull(), F.array().cast("array<double>"))


def _figures_of(pieces: Column) -> Column:
    def one(piece, k):
        return once(F.struct(F.substring_index(piece, _SHUT, 1).alias("raw"), F.substring_index(piece, _SHUT, -1).alias("rest")), lambda x: figure(x["raw"], x["rest"], k))

    def figure(raw, rest, k):
        # what stands before is the end of the piece before, its own figure included
        before = F.replace(F.get(pieces, k - 1), F.lit(_SHUT), F.lit(""))
        grouped = raw.rlike(r"^\d{1,3}(?:[.\s]\d{3})+")
        bare = ~F.contains(raw, F.lit(",")) & ~F.contains(raw, F.lit(".")) & ~grouped & (F.length(F.regexp_replace(raw, r"\D", "")) >= 3)
        small = raw.rlike(r"^\d{1,2}$") & (raw.try_cast("int") <= 31)
        good = (k > 0) & ~F.contains(F.substring(rest, 1, 2), F.lit("%")) & ~F.coalesce(before.rlike(r"\d[/.-]$"), F.lit(False)) & ~bare & ~F.coalesce(small, F.lit(False))
        return F.when(good, last_mark_amount(raw))

    return F.array_compact(F.transform(pieces, one))


def role(line: Column) -> Column:
    """``gross``, ``net``, ``tax`` or null by a line's words."""
    return once(F.upper(line), _role_of)


def _role_of(up: Column) -> Column:
    out = None
    for name, words in ROLES:
        said = up.rlike(rf"\b({'|'.join(words)})\b" if name != "gross" else rf"\b({'|'.join(w for w in words if w != 'GESAMT')})\b|\bGESAMT")
        out = F.when(said, name) if out is None else out.when(said, name)
    return out


def line_roles(text: Column) -> Column:
    """Lines of a text as struct(line, text, role, value, plain, date, own): role with its own last figure, or ``rate`` without one.

    Lines of metadata have no role. plain is the last figure whatever the line's role is, for labels above it.
    """
    last = lambda a: F.get(a, F.size(a) - 1)
    numbered, metadata = rf"(?i)\b({'|'.join(NUMBERED)})\s*[:.]?\s*\d", rf"(?i)\b({'|'.join(METADATA)})\b"

    def one(line, k):
        return once(F.struct(role(line).alias("said"), line.rlike(r"\d\s*%").alias("rate"), last(line_figures(line)).alias("plain")), lambda x: known_of(line, k, x))

    def known_of(line, k, x):
        said, rate = x["said"], x["rate"]
        known = F.when(~line.rlike(numbered) & ~line.rlike(metadata), said)
        value = F.when(rate, last(line_figures(F.regexp_replace(line, r"\d+[.,]?\d*\s*%", "")))).otherwise(x["plain"])
        return once(F.struct(known.alias("known"), F.when(said.isNotNull(), value).alias("value")), lambda y: settled(line, k, x, y["known"], y["value"]))

    def settled(line, k, x, known, value):
        return F.struct(k.alias("line"), F.when(known.isNotNull() & x["rate"] & value.isNull(), "rate").otherwise(known).alias("role"), F.when(known.isNotNull(), value).alias("value"), x["plain"].alias("plain"), (line.rlike(r"^\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}") | (line == "")).alias("passed"), x["said"].alias("own"))

    return F.transform(F.transform(F.split(text, r"\r\n|\r|\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), one)


def candidates(lines: Column) -> Column:
    """struct(role, value, line) of lines with a role: their own figure, else that of one of the next lines, up to another label."""
    def borrowed(x):
        start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(False).alias("over"))
        step = lambda a, y: F.when(a["over"] | a["v"].isNotNull() | y["passed"], a).otherwise(F.struct(F.when(y["own"].isNull(), y["plain"]).alias("v"), y["own"].isNotNull().alias("over")))
        return F.aggregate(F.slice(lines, x["line"] + 2, REACH), start, step, lambda a: a["v"])

    said = F.filter(lines, lambda x: x["role"].isin("gross", "net", "tax"))
    each = F.transform(said, lambda x: F.struct(x["role"].alias("role"), F.coalesce(x["value"], borrowed(x)).alias("value"), x["line"].alias("line")))
    return F.filter(each, lambda c: c["value"] <= MOST)


def _commonest(values: Column) -> Column:
    """The most frequent value of an array, the first seen of equals."""
    kinds = F.array_distinct(values)
    return F.array_max(F.transform(kinds, lambda v, k: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-k).alias("k"), v.alias("v"))))["v"]


def printed_rates(text: Column) -> Column:
    """Rates of a text: after a tax's name, then with two decimals, then whole; those over HIGHEST_RATE are none."""
    def both(pattern: str) -> Column:
        a, b = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
        return F.zip_with(a, b, lambda x, y: F.concat(x, F.when(y != "", F.concat(F.lit("."), y)).otherwise("")).try_cast("double"))

    named, parted, whole = r"(?i)(?:IVA|VAT|IMP\.?\s*IVA|MWST)[^\n%]{0,12}?(\d{1,2})\s*[.,]?\s*(\d{0,2})\s*%", r"(\d{1,2})[.,](\d{2})\s*%", r"\b(\d{1,2})(\s*)%"
    alone = F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(1)), lambda x: x.try_cast("double"))
    return F.filter(F.concat(both(named), both(parted), alone), lambda r: r <= HIGHEST_RATE)


def _coded(mark: Column) -> Column:
    return F.when(mark == "€", "EUR").when(mark == "$", "USD").otherwise(F.upper(mark))


def main_currency(text: Column) -> Column:
    """The currency whose marks and codes a text repeats most, the first seen of equals; null for none."""
    beside = F.regexp_extract_all(text, F.lit(rf"(?i)({_FIGURE})\s*({MARKS})"), F.lit(2))
    alone = F.regexp_extract_all(text, F.lit(rf"(?i)\b({CODES})\b"), F.lit(1))
    return _commonest(F.transform(F.concat(beside, alone), _coded))


def marked_amounts(text: Column) -> Column:
    """struct(value, currency) of amounts beside a currency mark; what stands after = or an exchange's word is a rate."""
    pieces = F.split(F.regexp_replace(text, rf"(?i)({_FIGURE})\s*({MARKS})", f"{_OPEN}$1{_SHUT}$2{_END}"), _OPEN, -1)

    def one(piece, k):
        value = last_mark_amount(F.substring_index(piece, _SHUT, 1))
        mark = F.substring_index(F.substring_index(piece, _END, 1), _SHUT, -1)
        before = F.get(pieces, k - 1)
        # of the twelve characters before, those that stood between figure and mark in the piece before don't matter
        near = F.substring(F.translate(before, f"{_SHUT}{_END}", ""), -12, 12)
        good = (k > 0) & (value > 0) & (value <= MOST) & ~F.coalesce(F.contains(near, F.lit("=")) | near.rlike(rf"(?i)\b({EXCHANGE})\b"), F.lit(False))
        return F.when(good, F.struct(value.alias("value"), _coded(mark).alias("currency")))

    return F.array_compact(F.transform(pieces, one))


def adjudicate(texts: DataFrame, key: str, text: str = "text", voted: Column | None = None) -> DataFrame:
    """key, gross, net, tax with the method of each, state, rate and currency of every text.

    ``voted`` is the amount that all passes read as charged in a card's currency, or null. The stages, each for what the ones
    before left open: the vote, if the text is in foreign money; a labelled trio that adds up, best by the printed rate; a
    total and a rate; net and tax that don't add up; a net and a rate; a total alone; the largest amount beside the main
    currency's mark; the largest plausible figure. A printed total of zero keeps the last two from guessing. Null and empty
    texts are ``missing``. Of equal trios the one with larger figures counts.
    """
    rows = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"), (F.lit(None).cast("double") if voted is None else voted).alias("voted"))
    rows = rows.withColumn("lines", line_roles(F.col("t"))).withColumn("found", candidates(F.col("lines")))
    of = lambda r: F.sort_array(F.array_distinct(F.transform(F.filter("found", lambda c: c["role"] == r), lambda c: c["value"])), asc=False)
    rows = rows.withColumns({"g": of("gross"), "n": of("net"), "x": of("tax"), "rates": printed_rates(F.col("t")), "home": main_currency(F.col("t"))})
    rows = rows.withColumns({"rate": _commonest(F.col("rates")), "currency": F.coalesce("home", F.when(F.contains("t", F.lit("$")), "USD").when(F.contains("t", F.lit("€")), "EUR"), F.lit("EUR"))})
    rate = F.col("rate")
    fits = lambda n, x: F.when(rate > 0, F.abs(_cents(n * rate / 100) - x) <= TAX_ERROR).otherwise(True)
    sums = lambda n, x: F.transform(F.filter("g", lambda g: F.abs(n + x - g) <= SUM_ERROR), lambda g: F.struct(fits(n, x).alias("fits"), (-F.abs(n + x - g)).alias("near"), g.alias("g"), n.alias("n"), x.alias("x")))
    rows = rows.withColumn("trio", F.array_max(F.flatten(F.transform("n", lambda n: F.flatten(F.transform("x", lambda x: sums(n, x)))))))
    rows = rows.withColumns({"marked": marked_amounts(F.col("t")), "any": F.filter(F.transform(F.regexp_extract_all("t", F.lit(f"({AMOUNT})"), F.lit(1)), lambda r: F.struct(last_mark_amount(r).alias("v"), r.rlike("[.,]").alias("parted"))), lambda a: (a["v"] > 0) & (a["v"] <= MOST))})
    own = F.filter("marked", lambda m: m["currency"] == F.col("home"))
    rows = rows.withColumn("beside", F.array_max(F.transform(F.when(F.size(own) > 0, own).otherwise(F.col("marked")), lambda m: m["value"])))
    parted = F.filter("any", lambda a: a["parted"])
    rows = rows.withColumn("pool", F.array_sort(F.transform(F.when(F.size(parted) > 0, parted).otherwise(F.col("any")), lambda a: a["v"])))
    middle = F.get("pool", (F.size("pool") / 2).cast("int"))
    rows = rows.withColumn("largest", F.array_max(F.filter("pool", lambda v: v <= F.greatest(middle, F.lit(1.0)) * TIMES)))

    def split(gross: Column) -> tuple[Column, Column]:
        net = _cents(gross / (1 + rate / 100))
        return net, _cents(gross - net)

    def stage(gross, gross_method, net, net_method, tax, tax_method, state) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        values = [lit(gross).cast("double"), lit(gross_method).cast("string"), lit(net).cast("double"), lit(net_method).cast("string"), lit(tax).cast("double"), lit(tax_method).cast("string"), lit(state)]
        return F.struct(*[v.alias(c) for v, c in zip(values, _METHODS, strict=True)])

    has = lambda c: F.size(c) > 0
    foreign = F.col("currency") != "EUR"
    told, derived = rate.isNotNull(), "derived_from_gross"
    by_total, by_mark, by_any = (split(c) for c in (F.get("g", F.lit(0)), F.col("beside"), F.col("largest")))
    of_net = _cents(F.get("n", F.lit(0)) * rate / 100)
    zero = F.exists("g", lambda v: v == 0)
    abroad = F.coalesce(F.col("home") != "EUR", F.lit(False))
    when_rate = lambda c: F.when(told, c)
    settled = (
        F.when(F.col("trio").isNotNull(), stage(F.col("trio.g"), "label", F.col("trio.n"), "label+arithmetic", F.col("trio.x"), "label+arithmetic", "confirmed"))
        .when(F.col("voted").isNotNull() & foreign, stage(F.col("voted"), "voted", 0.0, "foreign_without_tax", 0.0, "foreign_without_tax", "confirmed"))
        .when(has("g") & told, stage(F.get("g", F.lit(0)), "label", by_total[0], derived, by_total[1], derived, "derived"))
        .when(has("n") & has("x"), stage(F.when(has("g"), F.get("g", F.lit(0))).otherwise(_cents(F.get("n", F.lit(0)) + F.get("x", F.lit(0)))), F.when(has("g"), "label").otherwise("derived_sum"), F.get("n", F.lit(0)), "label_incoherent", F.get("x", F.lit(0)), "label_incoherent", "incoherent"))
        .when(has("n") & told, stage(_cents(F.get("n", F.lit(0)) + of_net), "derived", F.get("n", F.lit(0)), "label", of_net, "derived_rate", "derived"))
        .when(has("g"), stage(F.get("g", F.lit(0)), "label", None, None, None, None, "read"))
        .when(~zero & F.col("beside").isNotNull(), stage(F.col("beside"), "currency_marked", F.when(abroad, F.col("beside")).otherwise(by_mark[0]), F.when(abroad, "foreign_without_split").otherwise(when_rate(F.lit(derived))), F.when(abroad, 0.0).otherwise(by_mark[1]), F.when(abroad, "foreign_without_split").otherwise(when_rate(F.lit(derived))), "read"))
        .when(~zero & F.col("largest").isNotNull(), stage(F.col("largest"), "max_any", by_any[0], when_rate(F.lit(derived)), by_any[1], when_rate(F.lit(derived)), "read_weak"))
        .otherwise(stage(None, None, None, None, None, None, "missing"))
    )
    return rows.select(key, settled.alias("s"), "rate", "currency").select(key, "s.*", "rate", "currency")

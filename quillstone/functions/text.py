"""Normal forms of words and names, and how alike names are."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import FOLD_FROM, FOLD_TO

# A name that holds a term scores CONTAINED, if the term is at least MIN_SHARE of it.
CONTAINED = 0.9
MIN_SHARE = 0.5


def folded(x: Column) -> Column:
    """Lower case without diacritics, one letter for one."""
    return F.translate(F.lower(x), FOLD_FROM, FOLD_TO)


#: Ranges of letters whose compatible forms are taken apart: Latin, ligatures, letterlike signs, full-width forms.
_RANGES = ((0xA0, 0x250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2150), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))


@cache
def _plain_forms() -> tuple[str, str, list[tuple[str, str]]]:
    """What letters become without marks and case: one to one as two texts, and those that become several or none."""
    one, many = {}, []
    for low, high in _RANGES:
        for c in map(chr, range(low, high)):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
            if len(plain) == 1 and plain != c:
                one[c] = plain
            elif len(plain) != 1:
                many.append((c, plain))
    return "".join(one), "".join(one.values()), many


def label_normalised(x: Column) -> Column:
    """A word for comparing labels: compatible letters taken apart, without marks, case, and punctuation at either end.

    A letter may become several, as ß, ﬁ or ½ do. The tables are made by rule from the Unicode database.
    """
    source, target, many = _plain_forms()
    out = F.regexp_replace(F.translate(F.lower(F.translate(x, source, target)), source, target), r"\p{M}", "")
    odd = "".join(c for c, _ in many)
    wide = out
    for c, plain in many:
        wide = F.replace(wide, F.lit(c), F.lit(plain))
    out = F.when(out.rlike(f"[{odd}]"), wide).otherwise(out)
    return F.regexp_replace(out, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def supplier_normalised(x: Column) -> Column:
    """Trimmed, single-spaced, lower case; null for nothing. Accents stay."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(x), r"\s+", " ")), F.lit(""))


def word_normalised(x: Column) -> Column:
    """Lower case, without what is no letter or digit at either end."""
    return F.regexp_replace(F.lower(x), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def name_normalised(x: Column) -> Column:
    """A column's name as words: camel case is split, letters are folded, punctuation is space."""
    split = F.regexp_replace(x, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", " ")
    plain = folded(split)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """0 to 1 for two normalised names: the better of edit distance, with containment, and shared words."""
    la, lb = F.length(a), F.length(b)
    longer, shorter = F.when(la >= lb, a).otherwise(b), F.when(la >= lb, b).otherwise(a)
    most, least = F.greatest(la, lb), F.least(la, lb)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(most - least + 1, F.lit(1))), lambda i: F.levenshtein(shorter, longer.substr(i, least)))
    whole = (
        F.when(a == b, F.lit(1.0)).when(least / most >= MIN_SHARE, F.when(F.contains(longer, shorter), F.lit(CONTAINED)).otherwise(1 - F.array_min(windows) / most))
        .otherwise(1 - F.levenshtein(a, b) / most)
    )
    left, right = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = 2 * F.size(F.array_intersect(left, right)) / (F.size(left) + F.size(right))
    return F.when((la > 0) & (lb > 0), F.greatest(whole, shared)).otherwise(F.lit(0.0))


def country_of_locale(x: Column) -> Column:
    """Upper-case two-letter region of a locale such as es_ES, else null."""
    region = F.upper(F.try_element_at(F.split(x, "[_-]"), F.lit(2)))
    return F.when(region.rlike("^[A-Z]{2}$"), region)

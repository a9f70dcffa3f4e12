"""Text helpers: folding, parsing and es-CO number formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import col

#: Letters with accents and their plain forms.
ACCENTS, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def fold(x: str | Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(col(x)), ACCENTS, PLAIN)


def parse_decimal_comma(x: str | Column) -> Column:
    """'1.234,5' as 1234.5, null where it isn't a number."""
    return F.replace(F.replace(col(x), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def number(x: str | Column, digits: int = 4) -> Column:
    """Decimal comma, dots between thousands."""
    return F.translate(F.format_number(col(x), digits), ",.", ".,")


def integer(x: str | Column) -> Column:
    return number(x, 0)


def percent(x: str | Column, digits: int = 1) -> Column:
    return F.concat(number(col(x) * 100, digits), F.lit(" %"))


def p_value(p: str | Column) -> Column:
    p = col(p)
    return F.when(p < 0.001, "< 0,001").otherwise(number(p, 3))


def interval(low: str | Column, high: str | Column, digits: int = 4) -> Column:
    return F.concat(F.lit("["), number(low, digits), F.lit("; "), number(high, digits), F.lit("]"))


def listing(items: Column) -> Column:
    """'a', 'a y b', 'a, b y c'."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" y "), F.get(items, n - 1)))


def magnitude_suffix(x: str | Column) -> Column:
    """1.5K, 2.0M, 3.1B."""
    x = col(x)
    band = lambda d, s: F.concat(F.format_string("%.1f", x / F.lit(d)), F.lit(s))
    return F.when(F.abs(x) >= 1e9, band(1e9, "B")).when(F.abs(x) >= 1e6, band(1e6, "M")).when(F.abs(x) >= 1e3, band(1e3, "K")).otherwise(F.format_string("%.1f", x))


def tidy_math(x: str | Column) -> Column:
    """'$K=0$' as 'K = 0', '--' as a dash."""
    return F.regexp_replace(F.regexp_replace(col(x), r"\$([^$=]+)=([^$]+)\$", "$1 = $2"), "--", "–")


def from_inverted_index(index: Column) -> Column:
    """Text of a map word -> positions, words in order of position."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda e: e["w"]), " ")

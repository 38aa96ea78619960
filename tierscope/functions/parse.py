"""Text-to-number parsers for raw listing columns (native column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal / scientific literal, optionally padded with whitespace.
# Only the captured literal reaches try_cast, so Java-only spellings ("1d",
# "1.5f") and NaN/Infinity are rejected.
NUMBER_TEXT = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*$"


def to_number(text: Column) -> Column:
    """Coercing numeric parse: a numeric literal becomes a double, anything else null.

    The input is referenced once (extract, then try_cast of '' is null), so
    when Catalyst inlines this into pushed-down filters the input
    expression is not duplicated.
    """
    return F.regexp_extract(text, NUMBER_TEXT, 1).try_cast("double")


def as_double(c: Column, is_text: bool) -> Column:
    return to_number(c) if is_text else c.cast("double")


def parse_price(c: Column, is_text: bool = True) -> Column:
    """'$1,250.00' -> 1250.0; numeric input passes through as double."""
    if not is_text:
        return c.cast("double")
    return to_number(F.translate(c, "$,", ""))


def clip01(x: Column) -> Column:
    """Clip to [0, 1] while keeping nulls null (greatest/least would turn them into 1)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def percent_number(c: Column, is_text: bool = True) -> Column:
    """'195%' -> 1.95, not clipped; numeric input is not divided."""
    return to_number(F.regexp_replace(c, r"%+$", "")) / 100.0 if is_text else c.cast("double")


def parse_percent(c: Column, is_text: bool = True) -> Column:
    """'95%' -> 0.95 clipped to [0, 1]; numeric input is clipped but not divided."""
    return clip01(percent_number(c, is_text))


def parse_bool(c: Column) -> Column:
    """t/f/true/false (any case) -> 1.0/0.0; everything else -> null."""
    low = F.lower(c.cast("string"))
    return (F.when(low.isin("t", "true"), F.lit(1.0))
             .when(low.isin("f", "false"), F.lit(0.0))
             .otherwise(F.lit(None).cast("double")))


def first_number(text: Column) -> Column:
    """The first number in the text; null where it has none."""
    return to_number(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1))


def parse_bathrooms(numeric: Column, text: Column, numeric_is_text: bool = False, from_text: Column | None = None) -> Column:
    """Numeric column first; else the first number in the text (``from_text`` if known); else 0.5 for 'half'."""
    from_text = first_number(text) if from_text is None else from_text
    half = F.coalesce(F.lower(text).contains("half"), F.lit(False))
    from_text = F.when(from_text.isNull() & half, F.lit(0.5)).otherwise(from_text)
    return F.coalesce(as_double(numeric, numeric_is_text), from_text)


def r_as_numeric_price(c: Column) -> Column:
    """Research price parse: strip '$' and ',' then convert (null when not numeric)."""
    return to_number(F.regexp_replace(c.cast("string"), r"[$,]", ""))


def r_percent(c: Column) -> Column:
    """Research percent parse: drop every '%', divide by 100, no clipping."""
    return to_number(F.regexp_replace(c, "%", "")) / 100.0


def reviews_per_month_estimate(total_reviews: Column) -> Column:
    """Monthly review rate from a total over two years: round(n / 24, 2), half to even."""
    return F.bround(total_reviews.cast("double") / 24.0, 2)

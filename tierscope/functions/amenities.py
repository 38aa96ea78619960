"""Amenity list parsing and flags, entirely with native array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



# One list of quoted items without escapes, and text that begins with a word that is no JSON value.
QUOTED_LIST = r'^\["[^\\\x00-\x1f]*"\]\z'
BETWEEN_ITEMS = '" *, *"'
WORD = r"^(?!true|false|null)[A-Za-z]"


def _empty() -> Column:
    return F.array().cast("array<string>")


def parse_amenities(c: Column) -> Column:
    """Amenities text -> array<string>.

    * null / blank -> []
    * valid JSON: an array -> its elements; anything else -> []
    * malformed -> strip []{} from both ends, split on ',', strip spaces and
      double quotes from each piece, drop empty pieces.
    """
    blank = c.isNull() | c.rlike(r"^\s*$")
    fallback = F.filter(
        F.transform(F.split(F.btrim(c, F.lit("[]{}")), ","),
                    lambda t: F.btrim(t, F.lit(' "'))),
        lambda t: t != "",
    )
    # Strict validity decides first.  Spark's parsers take text after a value;
    # inside a list and inside an object there is no room for any.
    arr = F.from_json(c, "array<string>", {"allowSingleQuotes": "false"})
    in_list = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    # Three parses a row, and an exception for each that fails, cost most of the
    # feature job.  Where cutting a quoted list between its items leaves no
    # quote, the pieces are its items; text that begins with a word is no JSON.
    inside = F.substring(c, F.lit(3), F.length(c) - 4)
    plain = c.rlike(QUOTED_LIST) & ~F.regexp_replace(inside, BETWEEN_ITEMS, "").contains('"')
    return (F.when(blank, _empty())
             .when(plain, F.split(inside, BETWEEN_ITEMS))
             .when(c.rlike(WORD) | in_list.isNull() | in_object.isNull(), fallback)
             .otherwise(F.coalesce(arr, _empty())))


def flag_column(amenity: str) -> str:
    """Name of an amenity's 0/1 column."""
    return "has_" + amenity.lower().replace(" ", "_")


def amenity_flags(items: Column, amenities, exact: bool = False) -> list[Column]:
    """One 0/1 column per amenity.

    Default: case-insensitive *substring* test on the ' | '-joined list, so
    'washer' also matches 'Dishwasher' and 'pool' matches 'Pool table'.
    ``exact=True`` matches whole items instead.
    """
    if exact:
        lowered = F.transform(items, lambda t: F.lower(t))
        return [F.array_contains(lowered, a.lower()).cast("int").alias(flag_column(a)) for a in amenities]
    joined = F.lower(F.array_join(items, " | "))
    return [joined.contains(a.lower()).cast("int").alias(flag_column(a)) for a in amenities]


def approx_amenity_count(c: Column) -> Column:
    """Research count: occurrences of '",' plus one; 0 for null, '' or '[]'."""
    pieces = F.size(F.split(c, '",', -1)) - 1
    return (F.when(c.isNull() | (c == "") | (c == "[]"), F.lit(0))
             .otherwise(pieces + 1))

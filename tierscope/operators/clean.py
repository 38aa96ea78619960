"""Cleaning job: parse, filter, keep-first dedup, attach the price tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierscope.config import CONFIG, RAW_COLUMNS, Config
from tierscope.functions.buckets import price_category
from tierscope.functions.parse import (
    as_double, clip01, first_number, parse_bathrooms, parse_bool, parse_price, percent_number,
)
from tierscope.sources.files import require_columns

CLEANED_COLUMNS = [c for c in RAW_COLUMNS if c not in ("price", "bathrooms_text")] + [
    "price_numeric", "price_category"]

_LONG_COLUMNS = ("id", "accommodates", "number_of_reviews", "availability_365", "minimum_nights")
_DOUBLE_COLUMNS = ("bedrooms", "beds", "latitude", "longitude", "host_listings_count",
                   "review_scores_rating", "reviews_per_month")


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def typed_listings(raw: DataFrame) -> DataFrame:
    """Select the required columns by name and give each its fixed type.

    Text columns that should be numeric go through a guarded parse, so a
    stray word becomes null instead of failing the job.
    """
    require_columns(raw)
    cols = []
    for c in _LONG_COLUMNS:
        col = as_double(F.col(c), _is_text(raw, c)) if _is_text(raw, c) else F.col(c)
        cols.append(col.cast("long").alias(c))
    for c in _DOUBLE_COLUMNS:
        cols.append(as_double(F.col(c), _is_text(raw, c)).alias(c))
    if "ingest_seq" not in raw.columns:
        raise ValueError("listings need the order in which they were landed (ingest_seq)")
    # Rows that don't come from files have no file name; their sequence orders them alone.
    file = F.col("ingest_file") if "ingest_file" in raw.columns else F.lit("")
    # Parsed in a projection of their own: clipping and filling in name a number more than once.
    parsed = raw.withColumns({f"_{c}": percent_number(F.col(c), _is_text(raw, c)) for c in ("host_response_rate", "host_acceptance_rate")}
                             | {"_bathrooms": first_number(F.col("bathrooms_text"))})
    return parsed.select(
        *cols,
        file.alias("ingest_file"),
        F.col("ingest_seq").cast("long").alias("ingest_seq"),
        F.col("property_type").cast("string").alias("property_type"),
        F.col("room_type").cast("string").alias("room_type"),
        F.col("neighbourhood_cleansed").cast("string").alias("neighbourhood_cleansed"),
        F.col("amenities").cast("string").alias("amenities"),
        parse_price(F.col("price"), _is_text(raw, "price")).alias("price_numeric"),
        *[clip01(F.col(f"_{c}")).alias(c) for c in ("host_response_rate", "host_acceptance_rate")],
        *[parse_bool(F.col(c)).alias(c)
          for c in ("host_is_superhost", "host_identity_verified", "instant_bookable")],
        parse_bathrooms(F.col("bathrooms"), F.col("bathrooms_text"),
                        _is_text(raw, "bathrooms"), F.col("_bathrooms")).alias("bathrooms"),
    )


def keep_first(df: DataFrame, key: str = "id", order: tuple[str, ...] = ("ingest_file", "ingest_seq")) -> DataFrame:
    """First row per key in ingest order.

    ``row_number() = 1`` lets Spark insert a partial window-group limit
    before the shuffle, so each map task sends at most one row per key even
    when one key is very hot.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def clean_listings(raw: DataFrame, cfg: Config = CONFIG,
                   observations: tuple[Observation, Observation] | None = None) -> DataFrame:
    """Typed, priced and deduplicated listings, each with its tier.

    Rows without a price in range go first and copies of an id second: an id
    is kept if any of its copies has a price.  Catalyst leaves the filter
    below the window.
    """
    t = cfg.target
    df = typed_listings(raw)
    if observations is not None:
        df = df.observe(observations[0], F.count(F.lit(1)).alias("rows_in"))
    df = df.filter(F.col("price_numeric").isNotNull()
                   & F.col("price_numeric").between(t.min_price, t.max_price))
    df = keep_first(df)
    df = df.withColumn("price_category",
                       price_category(F.col("price_numeric"), t.budget_max, t.mid_market_max))
    df = df.select(*CLEANED_COLUMNS)
    return df if observations is None else df.observe(observations[1], F.count(F.lit(1)).alias("rows_out"))


def observed_retention(spark, observations: tuple[Observation, Observation]) -> DataFrame:
    """E38 from the counts that a cleaning job took while it wrote: no further scan."""
    rows_in, rows_out = observations[0].get["rows_in"], observations[1].get["rows_out"]
    return spark.createDataFrame([(rows_in, rows_out, 100.0 * rows_out / max(rows_in, 1))], "rows_in long, rows_out long, pct_kept double")


def retention(raw: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Rows in, rows out and percent kept for the cleaning plan (one row)."""
    rows_out = clean_listings(raw, cfg).select(F.count(F.lit(1))).scalar()
    return (raw.select(F.count(F.lit(1)).alias("rows_in"))
               .select("rows_in", rows_out.alias("rows_out"))
               .select("rows_in", "rows_out",
                       (F.lit(100.0) * F.col("rows_out") / F.greatest(F.col("rows_in"), F.lit(1)))
                       .alias("pct_kept")))

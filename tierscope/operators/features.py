"""Feature job: location, amenity, capacity and host features; vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.config import CATEGORICAL_FEATURES, CONFIG, NUMERIC_FEATURES, Config
from tierscope.functions.amenities import amenity_flags, flag_column, parse_amenities
from tierscope.functions.buckets import host_experience, property_size
from tierscope.functions.geo import haversine_km, nearest_point_km
from tierscope.operators.skew import join_on_hot_keys


def top_levels(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent non-null levels (ties broken by level), as a small frame.

    One partial+final aggregation; the result has at most n rows.
    """
    return (df.where(F.col(column).isNotNull()).groupBy(column).count()
              .orderBy(F.desc("count"), F.asc(column)).limit(n).select(column))


def fit_top_levels(df: DataFrame, column: str, n: int) -> list[str]:
    """Fit step of the top-N vocabulary: at most n strings reach the driver."""
    return [r[0] for r in top_levels(df, column, n).collect()]


def collapse_to_levels(c: Column, levels: list[str], other: str = "Other") -> Column:
    """Apply step: known level kept, everything else (nulls included) -> 'Other'."""
    return F.when(c.isin(levels), c).otherwise(F.lit(other)) if levels else F.lit(other)


def frequent_levels(df: DataFrame, column: str, min_count: int) -> DataFrame:
    """Levels seen at least ``min_count`` times (nulls excluded)."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).count()
              .where(F.col("count") >= min_count).select(column))


KEPT_LEVELS = 10_000   # at most, of a column whose kept levels are broadcast


def collapse_rare(df: DataFrame, column: str, min_count: int, other: str = "Other", most: int = KEPT_LEVELS) -> DataFrame:
    """Research rule: levels seen fewer than ``min_count`` times -> 'Other'; nulls stay.

    Few kept levels are broadcast, and one pass over the rows marks them.
    Many come back to the rows by a join that broadcasts those holding many
    rows, so a frequent level is not one task; null levels are not joined.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    kept = counts.where(F.col("_n") >= min_count).limit(most + 1).collect()
    if len(kept) <= most:
        known = df.sparkSession.createDataFrame([(r[column], True) for r in kept], f"`{column}` string, _keep boolean")
        seen = F.when(F.col(column).isNull() | F.col("_keep"), F.col(column)).otherwise(F.lit(other))
        return df.join(F.broadcast(known), column, "left").select(*[seen.alias(c) if c == column else F.col(c) for c in df.columns])
    levels = counts.select(column, "_n", (F.col("_n") >= min_count).alias("_keep"))
    known = join_on_hot_keys(df.where(F.col(column).isNotNull()), levels, column, "_n")
    kept = known.select(*[F.when(F.col("_keep"), F.col(column)).otherwise(F.lit(other)).alias(column) if c == column else F.col(c)
                          for c in df.columns])
    return kept.unionByName(df.where(F.col(column).isNull()))


def location_columns(cfg: Config = CONFIG) -> list[Column]:
    fc = cfg.features
    lat, lon = F.col("latitude"), F.col("longitude")
    return [
        haversine_km(lat, lon, fc.cbd_lat, fc.cbd_lon).alias("distance_from_cbd_km"),
        nearest_point_km(lat, lon, fc.beaches).alias("distance_to_beach_km"),
        F.coalesce(F.col("neighbourhood_cleansed").isin(list(fc.popular_areas)), F.lit(False))
        .cast("int").alias("is_popular_area"),
    ]


def engineer_features(cleaned: DataFrame, cfg: Config = CONFIG,
                      property_levels: list[str] | None = None) -> DataFrame:
    """Cleaned rows + model features; ``amenities`` is consumed.

    ``property_levels`` is the fitted top-N property-type vocabulary.  Without
    it the vocabulary is fitted on all of ``cleaned``, before any split, as the
    prepare job does it; serving passes the one stored with the model.
    """
    fc = cfg.features
    items = parse_amenities(F.col("amenities"))
    if property_levels is None:
        # Lazy fit: the vocabulary is a <= N-row frame (limit), so the
        # broadcast is size-bounded by construction.
        vocab = (top_levels(cleaned, "property_type", fc.max_property_types)
                 .withColumn("_known", F.lit(True)))
        src = cleaned.join(F.broadcast(vocab), "property_type", "left")
        pt = F.when(F.col("_known"), F.col("property_type")).otherwise(F.lit("Other"))
    else:
        src = cleaned
        pt = collapse_to_levels(F.col("property_type"), property_levels)
    base = [pt.alias(c) if c == "property_type" else F.col(c)
            for c in cleaned.columns if c != "amenities"]
    return (src.withColumn("_items", items)
                   .select(*base, *location_columns(cfg),
                           F.size("_items").alias("amenities_count"),
                           *amenity_flags(F.col("_items"), fc.key_amenities),
                           property_size(F.col("accommodates")).alias("property_size"),
                           host_experience(F.col("host_listings_count")).alias("host_experience")))


def model_inputs(cfg: Config = CONFIG) -> tuple[list[str], list[str]]:
    """Numeric inputs, the amenity flags among them, and categorical inputs of the models."""
    flags = [flag_column(a) for a in cfg.features.key_amenities]
    return [*NUMERIC_FEATURES, *flags], list(CATEGORICAL_FEATURES)


def usable_features(df: DataFrame, numeric: list[str], categorical: list[str]):
    """Drop features with no observed value (one count() pass over all of them)."""
    present = [c for c in numeric + categorical if c in df.columns]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in present]).first().asDict()
    dropped = [c for c in present if counts[c] == 0]
    return ([c for c in numeric if c not in dropped],
            [c for c in categorical if c not in dropped], dropped)

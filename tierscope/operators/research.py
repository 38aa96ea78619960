"""The research notebooks' cleaning + feature plan (earlier tier definition).

Differences from the production plan are deliberate and kept: tiers at
100/200 with zero included, price bounds (0, 1000], degree-space distance,
an approximate amenity count, NA-aware capacity/host buckets, global
imputation, whole-row distinct and min-frequency level collapsing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierscope.config import CONFIG, RESEARCH_COLUMNS, RESEARCH_POPULAR_AREAS, Config
from tierscope.functions.amenities import approx_amenity_count
from tierscope.functions.buckets import (
    availability_level, research_host_experience, research_price_category,
    research_property_size,
)
from tierscope.functions.geo import degree_distance
from tierscope.functions.parse import r_as_numeric_price, r_percent
from tierscope.operators.features import collapse_rare
from tierscope.operators.impute import fill_constants, fill_derived, fill_medians
from tierscope.session import checkpoint_dir
from tierscope.sources.files import coerce_tf_columns

# The notebooks' reader treats these spellings as missing.
R_NA_STRINGS = ["", "NA"]


def research_loaded(raw: DataFrame) -> DataFrame:
    """Reader NA rule, then 'N/A' -> '' in text columns, then t/f columns -> boolean."""
    cols = []
    for f in raw.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = (F.when(c.isNull() | c.isin(*R_NA_STRINGS), F.lit(None).cast("string"))
                  .when(c == "N/A", F.lit("")).otherwise(c))
        cols.append(c.alias(f.name))
    return coerce_tf_columns(raw.select(*cols))


def research_priced(raw: DataFrame) -> DataFrame:
    """The 20 selected columns plus parsed price and the research tier (all rows)."""
    cfg = CONFIG.research
    df = research_loaded(raw).select(*RESEARCH_COLUMNS)
    return df.withColumn("price_numeric", r_as_numeric_price(F.col("price"))).withColumn(
        "price_category",
        research_price_category(F.col("price_numeric"), cfg.budget_max, cfg.mid_market_max))


def research_filtered(raw: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Price in (0, max], superhost to boolean, response rate parsed, amenity count."""
    df = research_priced(raw).filter((F.col("price_numeric") > 0)
                                     & (F.col("price_numeric") <= cfg.research.max_price))
    sh = F.col("host_is_superhost")
    sh_bool = sh if isinstance(df.schema["host_is_superhost"].dataType, T.BooleanType) else (sh == "t")
    rr = F.col("host_response_rate")
    rr_num = rr.cast("double") if not isinstance(df.schema["host_response_rate"].dataType,
                                                 T.StringType) else r_percent(rr)
    return (df.withColumn("host_is_superhost", sh_bool)
              .withColumn("host_response_rate", rr_num)
              .withColumn("amenities_count", approx_amenity_count(F.col("amenities"))))


def research_imputed(raw: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    df = research_filtered(raw, cfg)
    df = fill_constants(df, {"reviews_per_month": 0.0, "host_is_superhost": False,
                             "host_listings_count": 1.0, "host_identity_verified": False})
    df = fill_medians(df, ["bathrooms", "review_scores_rating", "host_response_rate"])
    return fill_derived(df, "bedrooms", F.ceil(F.col("accommodates") / 2))


def research_features(raw: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Full research plan: imputed rows + features, whole-row distinct, tier, rare levels."""
    fc, rc = cfg.features, cfg.research
    df = research_imputed(raw, cfg).select(
        "*",
        F.coalesce(F.col("neighbourhood_cleansed").isin(RESEARCH_POPULAR_AREAS), F.lit(False))
        .alias("is_popular_area"),
        degree_distance(F.col("latitude"), F.col("longitude"), fc.cbd_lat, fc.cbd_lon)
        .alias("distance_from_cbd"),
        research_property_size(F.col("accommodates")).alias("property_size"),
        research_host_experience(F.col("host_listings_count")).alias("host_experience"),
        availability_level(F.col("availability_365")).alias("availability_level"),
    )
    df = df.distinct().withColumn(
        "price_category",
        research_price_category(F.col("price_numeric"), rc.budget_max, rc.mid_market_max))
    # Both rare-level passes read this frame again for one column each, so it
    # is written once, by columns, in the shared folder; that cuts the lineage.
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tierscope_distinct/{uuid.uuid4().hex}"
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    df = collapse_rare(df, "property_type", rc.property_type_min_count)
    return collapse_rare(df, "neighbourhood_cleansed", rc.neighbourhood_min_count)


def distinct_report(raw: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Rows before and after whole-row distinct, and the number removed."""
    df = research_imputed(raw, cfg)
    after = df.distinct().select(F.count(F.lit(1))).scalar()
    return (df.select(F.count(F.lit(1)).alias("rows_before"))
              .select("rows_before", after.alias("rows_after"))
              .withColumn("removed", F.col("rows_before") - F.col("rows_after")))

"""Registered queries (Spark) and their DuckDB oracles, keyed by survey id."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.config import TIER_MIDPOINTS
from tierscope.functions.hashing import HASH_BITS, stable_hash_sql
from tierscope.plans import base, market as mk
from tierscope.operators.quantiles import _null_safe_join
from tierscope.plans.oracle import with_base
from tierscope.session import checkpoint_dir, small_methods

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


# ----------------------------------------------------------------------------- jobs
@register("f01_clean_listings", with_base("SELECT * FROM cleaned"))
def f01(spark, sf):
    return base.cleaned(spark, sf)


@register("f02_engineer_features", with_base("SELECT * FROM features"))
def f02(spark, sf):
    return base.features(spark, sf)


# ----------------------------------------------------------------------------- market
_BAND = """CASE WHEN d > 0 AND d <= 2 THEN '0-2' WHEN d > 2 AND d <= 5 THEN '2-5'
  WHEN d > 5 AND d <= 10 THEN '5-10' WHEN d > 10 AND d <= 20 THEN '10-20'
  WHEN d > 20 AND d <= 40 THEN '20-40' WHEN d > 40 THEN '40+' END"""
_RING = """CASE WHEN d > 0 AND d <= 2 THEN '0–2' WHEN d > 2 AND d <= 4 THEN '2–4'
  WHEN d > 4 AND d <= 6 THEN '4–6' WHEN d > 6 AND d <= 8 THEN '6–8'
  WHEN d > 8 AND d <= 10 THEN '8–10' WHEN d > 10 AND d <= 15 THEN '10–15'
  WHEN d > 15 AND d <= 20 THEN '15–20' WHEN d > 20 AND d <= 100 THEN '20+' END"""


@register("e01_tier_counts", with_base("""
SELECT t.tier_pos, t.price_category, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       coalesce(c.n, 0) / (SELECT count(*) FROM features) AS share
FROM (VALUES (0, 'Budget'), (1, 'Mid-Market'), (2, 'Premium')) t(tier_pos, price_category)
LEFT JOIN (SELECT price_category, count(*) AS n FROM features GROUP BY 1) c USING (price_category)"""))
def e01(spark, sf):
    return mk.tier_counts(base.prepared(spark, sf))


@register("e03_median_by_distance_band", with_base(f"""
SELECT band, median(price_numeric) AS median_price, count(*) AS n
FROM (SELECT {_BAND} AS band, price_numeric FROM (SELECT distance_from_cbd_km AS d, price_numeric FROM features))
WHERE band IS NOT NULL GROUP BY band"""))
def e03(spark, sf):
    return mk.median_by_distance_band(base.prepared(spark, sf))


@register("e04_median_by_distance_ring", with_base(f"""
SELECT ring, median(price_numeric) AS median_price
FROM (SELECT {_RING} AS ring, price_numeric FROM (SELECT distance_from_cbd_km AS d, price_numeric FROM market))
WHERE ring IS NOT NULL GROUP BY ring"""))
def e04(spark, sf):
    return mk.median_by_distance_ring(base.market(spark, sf))


@register("e05_central_premium", with_base("""
SELECT near_median, far_median,
  CASE WHEN near_median IS NOT NULL AND far_median IS NOT NULL AND far_median <> 0
       THEN near_median / far_median - 1 END AS premium
FROM (SELECT median(price_numeric) FILTER (WHERE distance_from_cbd_km <= 5) AS near_median,
             median(price_numeric) FILTER (WHERE distance_from_cbd_km >= 15) AS far_median FROM market)"""))
def e05(spark, sf):
    return mk.central_premium(base.market(spark, sf))


@register("e06_kpi_band", with_base("""
SELECT count(*) AS listings, median(price_numeric) AS median_price,
  count(DISTINCT neighbourhood_cleansed) AS neighbourhoods,
  avg(CASE WHEN price_category = 'Premium' THEN 1.0e0 ELSE 0.0e0 END) AS premium_share,
  avg(host_is_superhost) AS superhost_share, median(review_scores_rating) AS median_rating
FROM market"""))
def e06(spark, sf):
    return mk.kpi_band(base.market(spark, sf))


@register("e07_header_totals", with_base("""
SELECT count(*) AS listings, count(DISTINCT neighbourhood_cleansed) AS neighbourhoods,
  median(price_numeric) AS median_price FROM features"""))
def e07(spark, sf):
    return mk.header_totals(base.prepared(spark, sf))


@register("e08_priciest_neighbourhoods", with_base("""
SELECT neighbourhood_cleansed, median(price_numeric) AS median_price, count(id) AS listings
FROM market GROUP BY neighbourhood_cleansed HAVING count(id) >= 100
ORDER BY median_price DESC, neighbourhood_cleansed LIMIT 11"""))
def e08(spark, sf):
    return mk.priciest_neighbourhoods(base.market(spark, sf))


@register("e09_priciest_vs_city", with_base("""
SELECT neighbourhood_cleansed, median_price, city_median, median_price / city_median - 1 AS vs_city
FROM (SELECT neighbourhood_cleansed, median(price_numeric) AS median_price,
        (SELECT median(price_numeric) FROM market) AS city_median
      FROM market GROUP BY neighbourhood_cleansed HAVING count(id) >= 100
      ORDER BY median_price DESC, neighbourhood_cleansed LIMIT 1)"""))
def e09(spark, sf):
    return mk.priciest_vs_city(base.market(spark, sf))


@register("e10_tier_mix_by_room", with_base("""
SELECT room_type, price_category, n, n / sum(n) OVER (PARTITION BY room_type) AS share
FROM (SELECT room_type, price_category, count(*) AS n FROM market GROUP BY 1, 2)"""))
def e10(spark, sf):
    return mk.tier_mix_by_room(base.market(spark, sf))


@register("e11_amenity_premiums", with_base("""
SELECT amenity, with_median, without_median, with_median - without_median AS premium
FROM (SELECT amenity, median(price_numeric) FILTER (WHERE flag = 1) AS with_median,
             median(price_numeric) FILTER (WHERE flag = 0) AS without_median
      FROM (UNPIVOT (SELECT price_numeric, has_pool, has_air_conditioning, has_free_parking,
                            has_washer, has_dishwasher, has_gym FROM market)
            ON has_pool, has_air_conditioning, has_free_parking, has_washer, has_dishwasher, has_gym
            INTO NAME amenity VALUE flag)
      GROUP BY amenity)
WHERE with_median IS NOT NULL AND without_median IS NOT NULL"""))
def e11(spark, sf):
    return mk.amenity_premiums(base.market(spark, sf))


@register("e12_room_type_counts", with_base(
    "SELECT room_type, count(*) AS n FROM market GROUP BY room_type"))
def e12(spark, sf):
    return mk.room_type_counts(base.market(spark, sf))


@register("e13_neighbourhood_profile", with_base("""
SELECT neighbourhood_cleansed, count(*) AS listings, median(price_numeric) AS median_price,
  median(review_scores_rating) AS median_rating, median(distance_from_cbd_km) AS median_distance_km,
  avg(host_is_superhost) AS superhost_share,
  median(price_numeric) / (SELECT median(price_numeric) FROM market) - 1 AS vs_city
FROM market GROUP BY neighbourhood_cleansed"""))
def e13(spark, sf):
    return mk.neighbourhood_profile(base.market(spark, sf))


@register("e14_neighbourhood_tier_mix", with_base("""
SELECT h.neighbourhood_cleansed, t.price_category, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY h.neighbourhood_cleansed) AS share
FROM (SELECT DISTINCT neighbourhood_cleansed FROM market) h
JOIN (VALUES ('Budget'), ('Mid-Market'), ('Premium')) t(price_category) ON true
LEFT JOIN (SELECT neighbourhood_cleansed, price_category, count(*) AS n FROM market GROUP BY 1, 2) c
  ON c.neighbourhood_cleansed IS NOT DISTINCT FROM h.neighbourhood_cleansed AND c.price_category = t.price_category"""))
def e14(spark, sf):
    return mk.neighbourhood_tier_mix(base.market(spark, sf))


@register("e15_comparables", with_base("""
SELECT neighbourhood_cleansed, room_type, count(*) AS n, median(price_numeric) AS median_price,
  quantile_cont(price_numeric, 0.25) AS q25, quantile_cont(price_numeric, 0.75) AS q75,
  median(review_scores_rating) AS median_rating
FROM features GROUP BY neighbourhood_cleansed, room_type"""))
def e15(spark, sf):
    return mk.comparables(base.prepared(spark, sf))


@register("e16_comps_standing", with_base("""
SELECT id, (SELECT count(*) FROM features c WHERE c.neighbourhood_cleansed IS NOT DISTINCT FROM f.neighbourhood_cleansed
              AND c.room_type IS NOT DISTINCT FROM f.room_type AND c.price_numeric < f.price_numeric)
         / count(*) OVER (PARTITION BY neighbourhood_cleansed, room_type) AS share_below
FROM features f"""))
def e16(spark, sf):
    return mk.comps_standing(base.prepared(spark, sf))


@register("e17_farther_from_cbd_share", with_base("""
SELECT id, (SELECT count(*) FROM features g WHERE g.distance_from_cbd_km > f.distance_from_cbd_km)
           / (SELECT count(*) FROM features) AS farther_share
FROM features f"""))
def e17(spark, sf):
    return mk.farther_from_cbd_share(base.prepared(spark, sf))


@register("e18_superhost_gap", with_base("""
SELECT superhost_median, other_median, superhost_median - other_median AS gap
FROM (SELECT median(price_numeric) FILTER (WHERE coalesce(host_is_superhost > 0, false)) AS superhost_median,
             median(price_numeric) FILTER (WHERE NOT coalesce(host_is_superhost > 0, false)) AS other_median
      FROM features)"""))
def e18(spark, sf):
    return mk.superhost_gap(base.prepared(spark, sf))


@register("e19_neighbourhood_centroids", with_base("""
SELECT neighbourhood_cleansed, median(latitude) AS latitude, median(longitude) AS longitude
FROM features GROUP BY neighbourhood_cleansed"""))
def e19(spark, sf):
    return mk.neighbourhood_centroids(base.prepared(spark, sf))


_HIST = """
WITH v AS (SELECT {value} AS x FROM {src} WHERE {value} IS NOT NULL),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
i AS (SELECT CASE WHEN hi - lo = 0 THEN 0
                  ELSE CAST(least(floor((x - lo) * ({bins}.0e0 / (hi - lo))), {last}) AS INTEGER) END AS bin,
             lo, hi FROM v, b)
SELECT bin, lo + bin * (hi - lo) / {bins} AS bin_lo, lo + (bin + 1) * (hi - lo) / {bins} AS bin_hi,
       count(*) AS n FROM i GROUP BY bin, lo, hi"""


@register("e34_price_histogram", with_base(
    _HIST.format(value="least(price_numeric, 1500.0e0)", src="features", bins=60, last=59)))
def e34(spark, sf):
    return mk.price_histogram(base.prepared(spark, sf))


@register("e35_tier_price_histogram", with_base("""
WITH kept AS (SELECT price_category, price_numeric FROM market
              WHERE price_numeric <= (SELECT quantile_cont(price_numeric, 0.98) FROM market)),
b AS (SELECT min(price_numeric) AS lo, max(price_numeric) AS hi FROM kept)
SELECT price_category, CASE WHEN hi - lo = 0 THEN 0
         ELSE CAST(least(floor((price_numeric - lo) * (40.0e0 / (hi - lo))), 39) AS INTEGER) END AS bin,
       count(*) AS n
FROM kept, b GROUP BY 1, 2"""))
def e35(spark, sf):
    return mk.tier_price_histogram(base.market(spark, sf))


@register("e36_comps_histogram", with_base("""
WITH caps AS (SELECT neighbourhood_cleansed, room_type, quantile_cont(price_numeric, 0.98) AS cap
              FROM features GROUP BY 1, 2),
v AS (SELECT f.neighbourhood_cleansed, f.room_type,
             CASE WHEN f.price_numeric > c.cap THEN c.cap ELSE f.price_numeric END AS x
      FROM features f JOIN caps c ON f.neighbourhood_cleansed IS NOT DISTINCT FROM c.neighbourhood_cleansed
        AND f.room_type IS NOT DISTINCT FROM c.room_type),
b AS (SELECT neighbourhood_cleansed, room_type, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1, 2)
SELECT v.neighbourhood_cleansed, v.room_type,
  CASE WHEN hi - lo = 0 THEN 0 ELSE CAST(least(floor((x - lo) * (34.0e0 / (hi - lo))), 33) AS INTEGER) END AS bin,
  count(*) AS n
FROM v JOIN b ON v.neighbourhood_cleansed IS NOT DISTINCT FROM b.neighbourhood_cleansed
  AND v.room_type IS NOT DISTINCT FROM b.room_type
GROUP BY 1, 2, 3"""))
def e36(spark, sf):
    return mk.comps_histogram(base.prepared(spark, sf))


@register("b07_default_price_range", with_base("""
SELECT CAST(floor(min(price_numeric)) AS BIGINT) AS lo,
       CAST(floor(quantile_cont(price_numeric, 0.99)) AS BIGINT) AS hi FROM features"""))
def b07(spark, sf):
    f = base.prepared(spark, sf)
    r = mk.default_price_range(f)
    return f.limit(1).select(r.getField("lo").alias("lo"), r.getField("hi").alias("hi"))


@register("b10_room_type_levels", with_base(
    "SELECT DISTINCT room_type FROM features WHERE room_type IS NOT NULL"))
def b10(spark, sf):
    return mk.levels(base.prepared(spark, sf), "room_type")


@register("b12_within_p98", with_base("""
SELECT id, price_numeric FROM market
WHERE price_numeric <= (SELECT quantile_cont(price_numeric, 0.98) FROM market)"""))
def b12(spark, sf):
    return mk.keep_at_most_quantile(base.market(spark, sf)).select("id", "price_numeric")


@register("g03_map_sample", with_base(f"""
SELECT id, latitude, longitude, price_category FROM market ORDER BY {stable_hash_sql("id", 7)}, id LIMIT 4000"""))
def g03(spark, sf):
    return mk.map_sample(base.market(spark, sf)).select("id", "latitude", "longitude", "price_category")


_MID = " ".join(f"WHEN '{t}' THEN {v!r}e0" for t, v in TIER_MIDPOINTS.items())
_REP = f"""
WITH comps AS (SELECT neighbourhood_cleansed, room_type, count(*) AS n, median(price_numeric) AS median_price
               FROM features GROUP BY 1, 2),
keys AS (SELECT DISTINCT neighbourhood_cleansed, room_type, price_category FROM features)
SELECT k.neighbourhood_cleansed, k.room_type, k.price_category, c.n,
  CASE WHEN c.n >= 10 THEN c.median_price ELSE CASE k.price_category {_MID} END END AS rate,
  c.n >= 10 AS from_comps
FROM keys k LEFT JOIN comps c ON k.neighbourhood_cleansed IS NOT DISTINCT FROM c.neighbourhood_cleansed
  AND k.room_type IS NOT DISTINCT FROM c.room_type"""


@register("c26_representative_rate", with_base(_REP))
def c26(spark, sf):
    return mk.representative_rate(base.prepared(spark, sf))


@register("c25_revenue_outlook", with_base(f"""
WITH r AS ({_REP})
SELECT f.id, r.rate, least(f.availability_365, 365) AS open_nights,
  r.rate * least(f.availability_365, 365) * 0.65e0 AS revenue_est,
  r.rate * least(f.availability_365, 365) * 0.55e0 AS revenue_low,
  r.rate * least(f.availability_365, 365) * 0.75e0 AS revenue_high
FROM features f JOIN r ON f.neighbourhood_cleansed IS NOT DISTINCT FROM r.neighbourhood_cleansed
  AND f.room_type IS NOT DISTINCT FROM r.room_type AND f.price_category = r.price_category"""))
def c25(spark, sf):
    f = base.prepared(spark, sf)
    keys = ["neighbourhood_cleansed", "room_type", "price_category"]
    rates = _null_safe_join(f.select("id", *keys, "availability_365"), mk.representative_rate(f), keys)
    return mk.revenue_outlook(rates, F.col("availability_365")).select(
        "id", "rate", "open_nights", "revenue_est", "revenue_low", "revenue_high")


# ----------------------------------------------------------------------------- research + profiling
from tierscope.operators import research as R  # noqa: E402
from tierscope.plans import profile as pf  # noqa: E402
from tierscope.plans.oracle import pct_round2_sql, with_research  # noqa: E402

_RESEARCH_COLS = """id, price, property_type, room_type, accommodates, bedrooms, bathrooms, amenities,
  neighbourhood_cleansed, latitude, longitude, host_is_superhost, host_response_rate, host_listings_count,
  host_identity_verified, review_scores_rating, number_of_reviews, reviews_per_month, availability_365,
  minimum_nights, price_numeric, price_category"""


@register("f03_research_features", with_research("SELECT * FROM research"))
def f03(spark, sf):
    return base.research_features(spark, sf)


@register("f05_research_medians", with_research("""
SELECT median(bathrooms) AS bathrooms, median(review_scores_rating) AS review_scores_rating,
  median(host_response_rate) AS host_response_rate FROM r_filtered"""))
def f05(spark, sf):
    return base.research_filtered(spark, sf).agg(
        F.median("bathrooms").alias("bathrooms"),
        F.median("review_scores_rating").alias("review_scores_rating"),
        F.median("host_response_rate").alias("host_response_rate"))


@register("d02_distinct_report", with_research("""
SELECT (SELECT count(*) FROM r_imputed) AS rows_before,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM r_imputed)) AS rows_after,
       (SELECT count(*) FROM r_imputed) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r_imputed)) AS removed"""))
def d02(spark, sf):
    return R.distinct_report(base.loaded_raw(spark, sf))


@register("e02_price_summary", with_research("""
SELECT min(price_numeric) AS min, quantile_cont(price_numeric, 0.25) AS q1, median(price_numeric) AS median,
  avg(price_numeric) AS mean, quantile_cont(price_numeric, 0.75) AS q3, max(price_numeric) AS max,
  count(*) FILTER (WHERE price_numeric IS NULL) AS n_missing FROM r_priced"""))
def e02(spark, sf):
    return pf.price_summary(base.research_priced(spark, sf))


def _missing_sql(src: str, cols: str) -> str:
    names = [c.strip() for c in cols.replace("\n", " ").split(",") if c.strip()]
    counts = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in names)
    return f"""
WITH c AS (SELECT count(*) AS _n, {counts} FROM {src}),
l AS (UNPIVOT c ON {", ".join(names)} INTO NAME variable VALUE missing_count)
SELECT variable, missing_count, {pct_round2_sql("missing_count", "_n")} AS missing_percent
FROM l WHERE missing_count > 0"""


@register("e20_missing_profile", with_research(_missing_sql("r_priced", _RESEARCH_COLS)))
def e20(spark, sf):
    return pf.missing_profile(base.research_priced(spark, sf))


@register("e20_missing_after_filter", with_research(
    _missing_sql("r_filtered", _RESEARCH_COLS + ", amenities_count")))
def e20b(spark, sf):
    return pf.missing_profile(base.research_filtered(spark, sf))


_ALL_RESEARCH = _RESEARCH_COLS + """, amenities_count, is_popular_area, distance_from_cbd, property_size,
  host_experience, availability_level"""


@register("e21_completeness", with_research(f"""
SELECT total_obs, complete_cases, {pct_round2_sql("complete_cases", "total_obs")} AS completeness_pct
FROM (SELECT count(*) AS total_obs,
        count(*) FILTER (WHERE {" AND ".join(c.strip() + " IS NOT NULL" for c in _ALL_RESEARCH.split(","))})
          AS complete_cases FROM research)"""))
def e21(spark, sf):
    return pf.completeness(base.research_prepared(spark, sf))


@register("e22_outlier_count", with_research("""
SELECT count(*) FILTER (WHERE price_numeric > (SELECT quantile_cont(price_numeric, 0.99) FROM r_priced)
                           OR price_numeric < (SELECT quantile_cont(price_numeric, 0.01) FROM r_priced))
  AS price_outliers FROM r_priced"""))
def e22(spark, sf):
    return pf.outlier_count(base.research_priced(spark, sf))


@register("e23_cardinality", with_research("""
SELECT count(DISTINCT neighbourhood_cleansed) + max(CAST(neighbourhood_cleansed IS NULL AS INTEGER)) AS n_neighbourhoods,
       count(DISTINCT property_type) + max(CAST(property_type IS NULL AS INTEGER)) AS n_property_types
FROM r_priced"""))
def e23(spark, sf):
    return pf.cardinality(base.research_priced(spark, sf))


@register("e24_class_imbalance", with_research("""
SELECT max_n / total AS max_share, min_n / total AS min_share, (max_n / total) / (min_n / total) AS imbalance_ratio
FROM (SELECT max(n) AS max_n, min(n) AS min_n, sum(n) AS total
      FROM (SELECT price_category, count(*) AS n FROM r_priced WHERE price_category IS NOT NULL GROUP BY 1))"""))
def e24(spark, sf):
    return pf.class_imbalance(base.research_priced(spark, sf))


@register("e25_property_type_tiers", with_research("""
SELECT property_type, price_category, n FROM (
  SELECT property_type, price_category, count(*) AS n,
         sum(count(*)) OVER (PARTITION BY property_type) AS type_n
  FROM research GROUP BY 1, 2) WHERE type_n >= 50"""))
def e25(spark, sf):
    return pf.property_type_tiers(base.research_prepared(spark, sf))


@register("e26_host_type_pivot", with_research("""
SELECT host_type,
  count(*) FILTER (WHERE price_category = 'Budget') AS Budget,
  count(*) FILTER (WHERE price_category = 'MidMarket') AS MidMarket,
  count(*) FILTER (WHERE price_category = 'Premium') AS Premium
FROM (SELECT CASE WHEN host_is_superhost THEN 'Superhost' ELSE 'Regular Host' END AS host_type, price_category
      FROM research WHERE host_is_superhost IS NOT NULL)
GROUP BY host_type"""))
def e26(spark, sf):
    return pf.host_type_pivot(base.research_prepared(spark, sf))


@register("e27_superhost_value_counts", with_research(
    "SELECT host_is_superhost, count(*) AS n FROM r_filtered GROUP BY 1"))
def e27(spark, sf):
    return pf.superhost_value_counts(base.research_filtered(spark, sf))


@register("e28_tier_means", with_research("""
SELECT price_category, avg(accommodates) AS mean_accommodates, avg(bedrooms) AS mean_bedrooms,
  avg(bathrooms) AS mean_bathrooms, avg(amenities_count) AS mean_amenities,
  avg(number_of_reviews) AS mean_reviews, avg(review_scores_rating) AS mean_rating,
  avg(distance_from_cbd) AS mean_distance_cbd, avg(availability_365) AS mean_availability
FROM research GROUP BY 1"""))
def e28(spark, sf):
    return pf.tier_means(base.research_prepared(spark, sf))


@register("e29_tier_by_superhost", with_research("""
SELECT price_category, host_is_superhost, count(*) AS n,
  count(*) / sum(count(*)) OVER (PARTITION BY price_category) AS share
FROM research GROUP BY 1, 2"""))
def e29a(spark, sf):
    return pf.tier_crosstab(base.research_prepared(spark, sf), "host_is_superhost")


@register("e29_tier_by_room_type", with_research("""
SELECT price_category, room_type, count(*) AS n,
  count(*) / sum(count(*)) OVER (PARTITION BY price_category) AS share
FROM research GROUP BY 1, 2"""))
def e29b(spark, sf):
    return pf.tier_crosstab(base.research_prepared(spark, sf), "room_type")


_BOX_UNION = " UNION ALL ".join(
    f"SELECT price_category, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM research WHERE {c} IS NOT NULL"
    for c in pf.BOX_FEATURES)


@register("e30_box_stats", with_research(f"""
WITH l AS ({_BOX_UNION}),
q AS (SELECT price_category, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1, 2)
SELECT l.price_category, l.feature, q1, median, q3,
  min(value) FILTER (WHERE value >= q1 - 1.5e0 * (q3 - q1) AND value <= q3 + 1.5e0 * (q3 - q1)) AS whisker_low,
  max(value) FILTER (WHERE value >= q1 - 1.5e0 * (q3 - q1) AND value <= q3 + 1.5e0 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE NOT (value >= q1 - 1.5e0 * (q3 - q1) AND value <= q3 + 1.5e0 * (q3 - q1))) AS n_outliers
FROM l JOIN q ON l.price_category IS NOT DISTINCT FROM q.price_category AND l.feature = q.feature
GROUP BY 1, 2, 3, 4, 5"""))
def e30(spark, sf):
    return pf.box_stats(base.research_prepared(spark, sf))


_CORR_COLS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in pf.CORRELATION_FEATURES)


@register("e31_price_correlations", with_research(f"""
WITH cc AS (SELECT {_CORR_COLS} FROM research
            WHERE {" AND ".join(c + " IS NOT NULL" for c in pf.CORRELATION_FEATURES)}),
r AS (SELECT {", ".join(f"corr(price_numeric, {c}) AS {c}" for c in pf.CORRELATION_FEATURES)} FROM cc)
UNPIVOT r ON {", ".join(pf.CORRELATION_FEATURES)} INTO NAME feature VALUE correlation"""))
def e31(spark, sf):
    return pf.price_correlations(base.research_prepared(spark, sf))


@register("e32_top_neighbourhoods", with_research("""
SELECT neighbourhood_cleansed, count(*) AS n FROM research GROUP BY 1
ORDER BY n DESC, neighbourhood_cleansed LIMIT 15"""))
def e32(spark, sf):
    return pf.top_neighbourhoods(base.research_prepared(spark, sf))


@register("e33_top_neighbourhood_prices", with_research("""
WITH top AS (SELECT neighbourhood_cleansed FROM research GROUP BY 1 ORDER BY count(*) DESC, neighbourhood_cleansed LIMIT 15)
SELECT neighbourhood_cleansed, count(*) AS count, median(price_numeric) AS median_price,
  avg(CASE WHEN price_category = 'Premium' THEN 1.0e0 ELSE 0.0e0 END) * 100 AS premium_pct
FROM research WHERE neighbourhood_cleansed IN (SELECT neighbourhood_cleansed FROM top) GROUP BY 1"""))
def e33(spark, sf):
    return pf.top_neighbourhood_prices(base.research_prepared(spark, sf))


def _hist_sql(value: str, src: str, bins: int) -> str:
    return _HIST.format(value=value, src=src, bins=bins, last=bins - 1)


@register("e37_price_histogram_50", with_research(_hist_sql("price_numeric", "research", 50)))
def e37a(spark, sf):
    return mk.histogram(base.research_prepared(spark, sf), F.col("price_numeric"), 50)


@register("e37_accommodates_histogram_15", with_research(
    _hist_sql("CAST(accommodates AS DOUBLE)", "research", 15)))
def e37b(spark, sf):
    return mk.histogram(base.research_prepared(spark, sf), F.col("accommodates").cast("double"), 15)


@register("e37_bedrooms_histogram_10", with_research(_hist_sql("bedrooms", "research", 10)))
def e37c(spark, sf):
    return mk.histogram(base.research_prepared(spark, sf), F.col("bedrooms"), 10)


@register("e37_tier_price_histogram_30", with_research("""
WITH v AS (SELECT price_category, price_numeric AS x FROM research WHERE price_numeric IS NOT NULL),
b AS (SELECT price_category, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1)
SELECT v.price_category, CASE WHEN hi - lo = 0 THEN 0
         ELSE CAST(least(floor((x - lo) * (30.0e0 / (hi - lo))), 29) AS INTEGER) END AS bin,
       count(*) AS n
FROM v JOIN b ON v.price_category IS NOT DISTINCT FROM b.price_category GROUP BY 1, 2"""))
def e37d(spark, sf):
    return mk.histogram(base.research_prepared(spark, sf), F.col("price_numeric"), 30,
                        ["price_category"]).drop("bin_lo", "bin_hi")


# ----------------------------------------------------------------------------- splits + evaluation
from tierscope.operators import split as sp  # noqa: E402
from tierscope.plans import evaluation as ev  # noqa: E402

# Per-class test counts: ceil(share * n) in total, floor of the proportional
# share per class, leftovers to the largest fractional parts (ties by label).
_ALLOC = """
WITH c AS (SELECT price_category, count(*) AS n_c FROM prepared GROUP BY 1),
t AS (SELECT *, sum(n_c) OVER () AS n, CAST(ceil({share}e0 * sum(n_c) OVER ()) AS BIGINT) AS n_test FROM c),
f AS (SELECT *, n_c * n_test / n AS cont, floor(n_c * n_test / n) AS fl FROM t),
g AS (SELECT *, cont - fl AS rem, n_test - sum(fl) OVER () AS short FROM f),
a AS (SELECT price_category, n_c,
        CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, price_category) <= short THEN 1 ELSE 0 END AS BIGINT) AS t_c
      FROM g)"""


def _split_summary_sql(share: float) -> str:
    return _ALLOC.format(share=share) + """
, s AS (SELECT 'test' AS split, price_category, t_c AS n FROM a
        UNION ALL SELECT 'train' AS split, price_category, n_c - t_c AS n FROM a)
SELECT split, price_category, n, n / sum(n) OVER (PARTITION BY split) AS share_in_split,
       n / sum(n) OVER () AS share_of_all FROM s"""


def _prepared_cte(body: str) -> str:
    return with_base(body, {"prepared": "SELECT * FROM features"})


@register("j01_stratified_split", _prepared_cte(_split_summary_sql(0.2)))
def j01(spark, sf):
    return sp.split_summary(sp.stratified_split(base.prepared(spark, sf)))


@register("j04_stratified_folds", _prepared_cte(_ALLOC.format(share=0.2) + """
, tr AS (SELECT price_category, n_c - t_c AS m FROM a),
folds AS (SELECT * FROM range(5) r(fold))
SELECT CAST(fold AS INTEGER) AS fold, price_category,
       CAST(m // 5 + CASE WHEN fold < m % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM tr JOIN folds ON true"""))
def j04(spark, sf):
    s = sp.stratified_split(base.prepared(spark, sf))
    return (s.where(F.col("split") == "train").groupBy("fold", "price_category")
             .agg(F.count(F.lit(1)).alias("n")))


# Rows of each class in hash order: the first t_c are the test rows, the rest are dealt to the folds.
def _split_rows_sql(share: float, seed: int, folds: int = 5, key: str = "id") -> str:
    return _ALLOC.format(share=share) + f""",
k AS (SELECT p.*, t_c, row_number() OVER (PARTITION BY p.price_category ORDER BY {stable_hash_sql(key, seed)}, {key}) AS rk
      FROM prepared p JOIN a ON a.price_category = p.price_category)
SELECT {key}, {"" if key == "id" else "id, "}price_category, CASE WHEN rk <= t_c THEN 'test' ELSE 'train' END AS split,
  CAST(CASE WHEN rk > t_c THEN (rk - t_c - 1) % {folds} END AS INTEGER) AS fold FROM k"""


@register("j01_split_rows", _prepared_cte(_split_rows_sql(0.2, 42)))
def j01_rows(spark, sf):
    return sp.stratified_split(base.prepared(spark, sf)).select("id", "price_category", "split", "fold")


_PSEUDO = """
SELECT id, price_category AS label,
  CASE WHEN room_type = 'Entire home/apt' THEN 'Premium' WHEN room_type = 'Hotel room' THEN 'Mid-Market'
       ELSE 'Budget' END AS prediction,
  -CAST(accommodates AS DOUBLE) AS "score_Budget", -abs(CAST(accommodates AS DOUBLE) - 4.0e0) AS "score_Mid-Market",
  CAST(accommodates AS DOUBLE) + coalesce(bedrooms, 0.0e0) AS "score_Premium",
  accommodates, bedrooms, review_scores_rating, distance_from_cbd_km, amenities_count
FROM features"""


def _eval_sql(body: str) -> str:
    return with_base(body, {"pred": _PSEUDO})


def _pred(spark, sf):
    return ev.pseudo_predictions(base.prepared(spark, sf))


_CM = """
cm AS (SELECT l.c AS label, p.c AS prediction, CAST(coalesce(x.n, 0) AS BIGINT) AS n
       FROM (VALUES ('Budget'), ('Mid-Market'), ('Premium')) l(c)
       JOIN (VALUES ('Budget'), ('Mid-Market'), ('Premium')) p(c) ON true
       LEFT JOIN (SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2) x
         ON x.label = l.c AND x.prediction = p.c)"""

_PC = _CM + """,
pc0 AS (SELECT r.label AS class, r.tp, r.support, c.predicted - r.tp AS fp, r.support - r.tp AS fn,
               (SELECT count(*) FROM pred) AS n_total
        FROM (SELECT label, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp, sum(n) AS support
              FROM cm GROUP BY 1) r
        JOIN (SELECT prediction, sum(n) AS predicted FROM cm GROUP BY 1) c ON c.prediction = r.label),
pc AS (SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
         CAST(n_total - tp - fp - fn AS BIGINT) AS tn, CAST(support AS BIGINT) AS support,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0e0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0e0 END AS recall,
         CASE WHEN (n_total - tp - fp - fn) + fp > 0 THEN (n_total - tp - fp - fn) / ((n_total - tp - fp - fn) + fp)
              ELSE 0.0e0 END AS specificity,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0e0 END AS f1
       FROM pc0)"""


@register("j18_confusion_matrix", _eval_sql("WITH " + _CM + " SELECT * FROM cm"))
def j18(spark, sf):
    return ev.confusion_matrix(_pred(spark, sf))


@register("j19_normalized_confusion", _eval_sql(
    "WITH " + _CM + " SELECT label, prediction, n, n / sum(n) OVER (PARTITION BY label) AS share FROM cm"))
def j19(spark, sf):
    return ev.normalized_confusion(_pred(spark, sf))


@register("j20_per_class_metrics", _eval_sql("WITH " + _PC + " SELECT * FROM pc"))
def j20(spark, sf):
    return ev.per_class_metrics(_pred(spark, sf))


@register("j21_summary_metrics", _eval_sql("WITH " + _PC + """
, s AS (SELECT sum(tp) AS tp_sum, sum(support) AS n, avg(precision) AS precision_macro, avg(recall) AS recall_macro,
          avg(f1) AS f1_macro, sum(support * (tp + fp)) AS pe_num FROM pc)
SELECT tp_sum / n AS accuracy, precision_macro, recall_macro, f1_macro,
  CASE WHEN pe_num / (n * n) < 1 THEN (tp_sum / n - pe_num / (n * n)) / (1 - pe_num / (n * n)) ELSE 0.0e0 END AS kappa,
  CAST(n AS BIGINT) AS n FROM s"""))
def j21(spark, sf):
    return ev.summary_metrics(_pred(spark, sf))


_LONG_SCORES = """
long AS (SELECT label, 'Budget' AS class, "score_Budget" AS score FROM pred
         UNION ALL SELECT label, 'Mid-Market', "score_Mid-Market" FROM pred
         UNION ALL SELECT label, 'Premium', "score_Premium" FROM pred),
vc AS (SELECT class, score, count(*) FILTER (WHERE label = class) AS pos,
              count(*) FILTER (WHERE label <> class) AS neg FROM long GROUP BY 1, 2),
cum AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_below, coalesce(sum(neg) OVER w, 0) AS neg_below
        FROM vc WINDOW w AS (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register("j22_auc_ovr", _eval_sql("WITH " + _LONG_SCORES + """,
per AS (SELECT class, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                           THEN sum(pos * (neg_below + 0.5e0 * neg)) / (sum(pos) * sum(neg)) END AS auc
        FROM cum GROUP BY class)
SELECT class, auc FROM per
UNION ALL
SELECT 'macro', (((0.0e0 + (SELECT auc FROM per WHERE class = 'Budget')) + (SELECT auc FROM per WHERE class = 'Mid-Market'))
                 + (SELECT auc FROM per WHERE class = 'Premium')) / 3"""))
def j22(spark, sf):
    return ev.auc_ovr(_pred(spark, sf))


@register("j23_roc_points", _eval_sql("WITH " + _LONG_SCORES + """
SELECT class, score AS threshold,
  (sum(neg) OVER (PARTITION BY class) - neg_below) / sum(neg) OVER (PARTITION BY class) AS fpr,
  (sum(pos) OVER (PARTITION BY class) - pos_below) / sum(pos) OVER (PARTITION BY class) AS tpr
FROM cum"""))
def j23(spark, sf):
    return ev.roc_points(_pred(spark, sf))


@register("j27_misclassification_patterns", _eval_sql("""
SELECT label, prediction, count(*) AS n,
  count(*) / (SELECT count(*) FROM pred WHERE label <> prediction) AS share_of_errors
FROM pred WHERE label <> prediction GROUP BY 1, 2"""))
def j27(spark, sf):
    return ev.misclassification_patterns(_pred(spark, sf))


_J28_FEATURES = ["accommodates", "bedrooms", "review_scores_rating", "distance_from_cbd_km", "amenities_count"]


@register("j28_correct_vs_incorrect", _eval_sql(
    "SELECT label = prediction AS correct, " + ", ".join(f"avg({c}) AS mean_{c}" for c in _J28_FEATURES)
    + " FROM pred GROUP BY 1"))
def j28(spark, sf):
    return ev.correct_vs_incorrect_means(_pred(spark, sf), _J28_FEATURES)


@register("j29_accuracy_by_class", _eval_sql("""
SELECT label, avg(CASE WHEN label = prediction THEN 1.0e0 ELSE 0.0e0 END) AS accuracy, count(*) AS n
FROM pred GROUP BY 1"""))
def j29(spark, sf):
    return ev.accuracy_by_class(_pred(spark, sf))


@register("j30_tier_distance_errors", _eval_sql("""
SELECT tier_distance, n, n / sum(n) OVER () AS share FROM (
  SELECT CAST(abs(list_position(['Budget', 'Mid-Market', 'Premium'], label)
                  - list_position(['Budget', 'Mid-Market', 'Premium'], prediction)) AS INTEGER) AS tier_distance,
         count(*) AS n FROM pred GROUP BY 1)"""))
def j30(spark, sf):
    return ev.tier_distance_errors(_pred(spark, sf))


# ----------------------------------------------------------------------------- models
from dataclasses import replace  # noqa: E402

from tierscope.config import CONFIG, RESEARCH_TIER_ORDER, TIER_ORDER, Config  # noqa: E402
from tierscope.plans import importance as IMP  # noqa: E402
from tierscope.plans import model as M  # noqa: E402
from tierscope.plans import research_model as RM  # noqa: E402
from tierscope.plans.kernel_map import KernelMap  # noqa: E402
from tierscope.plans.kept import fingerprint, kept, kept_table, shared_root  # noqa: E402

# The jobs train with the settings of CONFIG.  A registered query is one run
# among many, so its forests are smaller (see README).
QUERY_CFG = Config(model=replace(CONFIG.model, forest_trees=100, forest_depth=12))

_KEPT: dict = {}


def _once(spark, sf, name: str, make):
    """Tables and fitted models that several queries read, made once a process."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        with small_methods(spark):
            _KEPT[key] = make()
    return _KEPT[key]


def _split_parts(spark, sf):
    """(train, test, numeric, categorical) of the prepared table."""
    def make():
        split, numeric, categorical = M.training_frame(base.prepared(spark, sf))
        return (*M.written_split(split), numeric, categorical)
    return _once(spark, sf, "split", make)


def _stages(spark, sf):
    train, _, numeric, categorical = _split_parts(spark, sf)
    return _once(spark, sf, "stages", lambda: M.feature_stages(train, numeric, categorical))


def _data_key(spark, sf) -> str:
    """Fingerprint of the split rows: what is kept from other rows or settings is another entry."""
    train, test, *_ = _split_parts(spark, sf)
    return _once(spark, sf, "fingerprint", lambda: fingerprint(train.unionByName(test), QUERY_CFG))


def _fitted(spark, sf, name: str):
    def make(folder):
        train, _, numeric, categorical = _split_parts(spark, sf)
        model = M.fit_candidate(M.candidates(QUERY_CFG)[name], train, numeric, categorical, QUERY_CFG, _stages(spark, sf))
        M.save_model(spark, model, folder, QUERY_CFG)

    return _once(spark, sf, f"model {name}", lambda: kept(
        spark, shared_root(spark), f"model-{name}", _data_key(spark, sf), make, lambda folder: M.load_model(spark, folder)))


def _scores(scored: DataFrame, classes) -> DataFrame:
    return scored.select("id", "label", "prediction", *[F.col(f"score_{t}") for t in classes])


def _fit_eval(name: str):
    def q(spark, sf):
        return _scores(M.scored_frame(_fitted(spark, sf, name), _split_parts(spark, sf)[1]), TIER_ORDER)
    return q


_TRAIN_COUNTS = f"""s AS ({_split_rows_sql(0.2, 42)}),
n AS (SELECT price_category, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1),
m AS (SELECT price_category AS most FROM n ORDER BY n DESC, price_category LIMIT 1)"""

_J06 = f"""WITH {_TRAIN_COUNTS}
SELECT id, price_category AS label, most AS prediction,
  {", ".join(f"CASE WHEN most = '{t}' THEN 1.0e0 ELSE 0.0e0 END AS " + chr(34) + f"score_{t}" + chr(34) for t in TIER_ORDER)}
FROM s, m WHERE split = 'test'"""

for _key, _name, _sql in [("j06_majority_baseline", "baseline_majority", _prepared_cte(_J06)),
                          ("j08_logistic_regression", "logistic_regression", None),
                          ("j09_random_forest", "random_forest", None), ("j10_gradient_boosting", "gradient_boosting", None)]:
    register(_key, _sql)(_fit_eval(_name))


# Each candidate's cross-validation is a job of its own that writes its fold scores.
def _cv(spark, sf, name: str) -> DataFrame:
    def make():
        train, _, numeric, categorical = _split_parts(spark, sf)
        folds = CONFIG.model.cv_folds
        shared = _once(spark, sf, "fold stages", lambda: M.fold_stages(train, numeric, categorical, folds))
        scores = M.cross_validate(M.candidates(QUERY_CFG)[name], train, numeric, categorical, folds, QUERY_CFG, stages=shared)
        return spark.createDataFrame([(name, k, float(x)) for k, x in enumerate(scores)], "model string, fold int, f1_macro double")

    return _once(spark, sf, f"cv {name}", lambda: kept_table(spark, shared_root(spark), f"cv-{name}", _data_key(spark, sf), make))


def _cv_query(name: str):
    return lambda spark, sf: _cv(spark, sf, name)


# The majority class of every fold's training rows, scored on the fold.
_CV_MAJORITY = f"""WITH s AS ({_split_rows_sql(0.2, 42)}),
k AS (SELECT * FROM range(5) r(fold)),
n AS (SELECT k.fold, price_category, count(*) AS n FROM k JOIN s ON s.split = 'train' AND s.fold <> k.fold GROUP BY 1, 2),
m AS (SELECT fold, price_category AS most FROM n QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, price_category) = 1),
v AS (SELECT s.fold, count(*) AS n, count(*) FILTER (WHERE price_category = most) AS tp
      FROM s JOIN m ON m.fold = s.fold WHERE split = 'train' GROUP BY 1)
SELECT 'baseline_majority' AS model, fold, (2 * tp / (tp + n)) / 3 AS f1_macro FROM v"""

for _key, _name, _sql in [("j15_cv_majority", "baseline_majority", _prepared_cte(_CV_MAJORITY)),
                          ("j15_cv_logistic", "logistic_regression", None),
                          ("j15_cv_forest", "random_forest", None), ("j15_cv_boosting", "gradient_boosting", None)]:
    register(_key, _sql)(_cv_query(_name))


def _cv_scores(spark, sf) -> DataFrame:
    parts = [_cv(spark, sf, name) for name in CONFIG.model.candidates]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("j24_cv_summary", _prepared_cte(f"""
SELECT model, count(*) AS folds, avg(f1_macro) AS mean, stddev_pop(f1_macro) AS std FROM ({_CV_MAJORITY}) GROUP BY 1"""))
def j24(spark, sf):
    return ev.cv_summary(_cv(spark, sf, "baseline_majority"))


def _tested(spark, sf, name: str) -> dict:
    return _once(spark, sf, f"test {name}", lambda: M.evaluate(_fitted(spark, sf, name), _split_parts(spark, sf)[1]))


def _selection(spark, sf) -> DataFrame:
    """One row a candidate, the winners marked."""
    tests = spark.createDataFrame(
        [(name, float(t["accuracy"]), float(t["f1_macro"]), float(t["roc_auc_ovr_macro"]))
         for name, t in ((n, _tested(spark, sf, n)) for n in CONFIG.model.candidates)],
        "model string, accuracy double, f1_macro double, roc_auc_ovr_macro double")
    rows = ev.cv_summary(_cv_scores(spark, sf)).join(tests, "model")
    contender = F.when(~F.col("model").startswith("baseline_"), F.col("mean"))
    best = rows.agg(F.max_by("model", contender).alias("cv"), F.max_by("model", "accuracy").alias("test")).select(F.struct("cv", "test")).scalar()
    return rows.select("model", F.col("mean").alias("cv_mean"), F.col("std").alias("cv_std"), F.col("folds").cast("int").alias("cv_folds"),
                       "accuracy", "f1_macro", "roc_auc_ovr_macro", (F.col("model") == best.getField("cv")).alias("selected"),
                       (F.col("model") == best.getField("test")).alias("best_test_accuracy"))


@register("j15_model_selection")
def j15(spark, sf):
    return _selection(spark, sf)


@register("j17_batch_scoring")
def j17(spark, sf):
    return M.score_batch(_fitted(spark, sf, "logistic_regression"), base.prepared(spark, sf))


# What any fit must fulfil, whatever its numbers.
@register("j17_scoring_invariants", _prepared_cte("""
SELECT (SELECT count(*) FROM prepared) AS rows, (SELECT count(*) FROM prepared) AS sums_to_one,
       (SELECT count(*) FROM prepared) AS confident_in_tier, (SELECT count(*) FROM prepared) AS has_band"""))
def j17_invariants(spark, sf):
    return j17(spark, sf).select(
        F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, p: a + p).alias("total"),
        (F.col("confidence") == F.element_at("probabilities", F.col("tier"))).alias("own"), "band").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("total") - 1) < 1e-9).alias("sums_to_one"),
        F.count_if("own").alias("confident_in_tier"), F.count("band").alias("has_band"))


@register("j08_beats_majority", "SELECT true AS beats_majority")
def j08_beats(spark, sf):
    better = _tested(spark, sf, "logistic_regression")["f1_macro"] > _tested(spark, sf, "baseline_majority")["f1_macro"]
    return spark.createDataFrame([(better,)], "beats_majority boolean")


@register("j26_tree_importance")
def j26(spark, sf):
    model = _fitted(spark, sf, "random_forest")
    return spark.createDataFrame(M.input_importances(model)[:15], "feature string, importance double")


@register("j32_artifact_metadata", _prepared_cte(f"""WITH {_TRAIN_COUNTS}
SELECT 'baseline_random' AS model, {CONFIG.model.random_state} AS seed, '{CONFIG.snapshot_date}' AS snapshot_date,
  {", ".join(f"(SELECT n FROM n WHERE price_category = '{t}') / (SELECT sum(n) FROM n) AS " + chr(34) + f"share_{t}" + chr(34) for t in TIER_ORDER)}"""))
def j32(spark, sf):
    """A model saved, loaded and described: what it needs to score comes back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tierscope_models/{uuid.uuid4().hex}"
    M.save_model(spark, _fitted(spark, sf, "baseline_random"), path, QUERY_CFG)
    back = M.load_model(spark, path)
    meta = spark.read.json(f"{path}/metadata").select(F.get_json_object("metadata", "$.snapshot_date").alias("snapshot_date"))
    return meta.select(F.lit(back.name).alias("model"), F.lit(back.seed).alias("seed"), "snapshot_date",
                       *[F.lit(p).alias(f"share_{t}") for t, p in zip(TIER_ORDER, back.class_shares, strict=True)])


# ----------------------------------------------------------------------------- fitted preprocessing
from tierscope.config import CATEGORICAL_FEATURES, CONTINUOUS_FEATURES  # noqa: E402, F401
from tierscope.operators.features import model_inputs  # noqa: E402

_NUM, _CAT = model_inputs()
_TRAIN_ROWS = f"s AS ({_split_rows_sql(0.2, 42)}),\ntr AS (SELECT p.* FROM prepared p JOIN s ON s.id = p.id WHERE s.split = 'train')"
_STATS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, median(CAST({c} AS DOUBLE)) AS med,
  avg(coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM tr))) AS mean,
  coalesce(nullif(stddev_pop(coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM tr))), 0), 1) AS std
FROM tr""" for c in _NUM if c != "instant_bookable")


@register("f07_fitted_numeric_statistics", _prepared_cte(f"WITH {_TRAIN_ROWS}\n{_STATS_SQL}"))
def f07(spark, sf):
    """Median, mean and population deviation (1 for a constant) of every numeric input over the training rows."""
    prep = _stages(spark, sf)[0]
    train, _, numeric, _ = _split_parts(spark, sf)
    med, mean, std = M.numeric_statistics(prep, numeric)
    return spark.createDataFrame([(c, med[c], mean[c], std[c]) for c in numeric], "feature string, med double, mean double, std double")


@register("f09_fitted_levels", _prepared_cte(f"WITH {_TRAIN_ROWS},\n" + """m AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode" for c in _CAT) + """),
l AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce({c}, (SELECT mode FROM m WHERE feature = '{c}')) AS level, count(*) AS n FROM tr GROUP BY 2" for c in _CAT) + """)
SELECT feature, level, CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) - 1 AS INTEGER) AS position FROM l"""))
def f09(spark, sf):
    """levels of every categorical input, the mode standing in for nulls, in one-hot order."""
    return spark.createDataFrame([(c, level, i) for c, levels in _level_order(spark, sf).items() for i, level in enumerate(levels)],
                                 "feature string, level string, position int")


def _level_order(spark, sf) -> dict[str, list[str]]:
    return _once(spark, sf, "levels", lambda: M.category_labels(_fitted(spark, sf, "baseline_majority")))


@register("f14_label_index", """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS position
FROM (VALUES ('Budget'), ('Mid-Market'), ('Premium')) t(label)""")
def f14(spark, sf):
    labels = _fitted(spark, sf, "baseline_majority").pipeline.stages[-1].labels
    return spark.createDataFrame([(c, i) for i, c in enumerate(labels)], "label string, position int")


# ----------------------------------------------------------------------------- research models
_R_SPLIT = _split_rows_sql(RM.TEST_SIZE, RM.SEED, key="row_key")


def _research_cte(body: str) -> str:
    return with_research(body, {"prepared": f"SELECT *, concat_ws('|', id, CAST(price_numeric AS BIGINT)) AS row_key FROM research WHERE {' AND '.join(c + ' IS NOT NULL' for c in RM.INPUTS)}"})


def _research(spark, sf):
    return _once(spark, sf, "research split", lambda: M.written_split(RM.split(base.research_prepared(spark, sf))))


@register("j02_stratified_split_70_30", _research_cte(_split_summary_sql(RM.TEST_SIZE)))
def j02(spark, sf):
    train, test = _research(spark, sf)
    return sp.split_summary(train.unionByName(test))


@register("j05_repeated_folds", _research_cte(" UNION ALL ".join(f"""
SELECT CAST({rep} AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY price_category
  ORDER BY {stable_hash_sql("row_key", seed)}, row_key) - 1) % {RM.FOLDS} AS INTEGER) AS fold, price_category, row_key
FROM ({_R_SPLIT}) WHERE split = 'train'""" for rep, seed in enumerate(RM.REPEAT_SEEDS))))
def j05(spark, sf):
    """Repeated stratified k-fold (3 seeds x 5 folds) of the research training rows: every row's fold in each repeat."""
    return RM.repeated_folds(_research(spark, sf)[0]).select("repeat", "fold", "price_category", "row_key")


_R_COUNTS = f"""s AS ({_R_SPLIT}),
n AS (SELECT price_category, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1),
h AS (SELECT (SELECT n FROM n WHERE price_category = 'Budget') / (SELECT sum(n) FROM n) AS p1,
             (SELECT n FROM n WHERE price_category = 'MidMarket') / (SELECT sum(n) FROM n) AS p2,
             (SELECT n FROM n WHERE price_category = 'Premium') / (SELECT sum(n) FROM n) AS p3)"""


@register("j07_random_baseline", _research_cte(f"""WITH {_R_COUNTS}
SELECT id, price_category AS label,
  CASE WHEN u < p1 THEN 'Budget' WHEN u < p1 + p2 THEN 'MidMarket' ELSE 'Premium' END AS prediction,
  p1 AS "score_Budget", p2 AS "score_MidMarket", p3 AS "score_Premium"
FROM (SELECT *, CAST({stable_hash_sql("id", CONFIG.model.random_state)} AS DOUBLE) / {float(1 << HASH_BITS)!r} AS u FROM s WHERE split = 'test'), h"""))
def j07(spark, sf):
    return _research_fit(spark, sf, "baseline_random", RM.NUMERIC, [])


def _research_fit(spark, sf, name, numeric, categorical) -> DataFrame:
    train, test = _research(spark, sf)
    fitted = _once(spark, sf, f"research {name}", lambda: M.fit_candidate(
        M.candidates(QUERY_CFG)[name], train, numeric, categorical, QUERY_CFG, classes=RESEARCH_TIER_ORDER))
    return _scores(M.scored_frame(fitted, test, RESEARCH_TIER_ORDER), RESEARCH_TIER_ORDER)


@register("j14_linear_svm")
def j14(spark, sf):
    return _research_fit(spark, sf, "linear_svm", RM.NUMERIC, RM.CATEGORICAL)


_R_TRAIN = f"tr AS (SELECT p.* FROM prepared p JOIN ({_R_SPLIT}) s ON s.row_key = p.row_key WHERE s.split = 'train')"


@register("j11_class_means", _research_cte(f"WITH {_R_TRAIN} " + " UNION ALL ".join(
    f"SELECT price_category, '{c}' AS feature, count(*) AS n, avg(CAST({c} AS DOUBLE)) AS mean FROM tr GROUP BY 1" for c in RM.NUMERIC)))
def j11_means(spark, sf):
    means, _ = M.lda_statistics(_research(spark, sf)[0], RM.NUMERIC)
    return means.unpivot(["price_category", "n"], RM.NUMERIC, "feature", "mean")


@register("j11_pooled_covariance", _research_cte(f"""WITH {_R_TRAIN},
c AS (SELECT price_category, {", ".join(f"CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER (PARTITION BY price_category) AS {c}" for c in RM.NUMERIC)} FROM tr),
d AS (SELECT count(*) - count(DISTINCT price_category) AS df FROM tr) """ + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, (SELECT sum({a} * {b}) FROM c) / df AS value FROM d"
    for i, a in enumerate(RM.NUMERIC) for b in RM.NUMERIC[i:])))
def j11_covariance(spark, sf):
    _, cov = M.lda_statistics(_research(spark, sf)[0], RM.NUMERIC)
    return cov


@register("j14_rbf_svm")
def j14_rbf(spark, sf):
    """The margin classifier with a curved boundary, over a random feature map of the RBF kernel."""
    return _research_fit(spark, sf, "rbf_svm", RM.NUMERIC, RM.CATEGORICAL)


_MAP = KernelMap(width=len(RM.NUMERIC), size=4)
_MAP_X = "[" + ", ".join(f"(CAST(p.{c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM tr)) / (SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM tr)" for c in RM.NUMERIC) + "]"


@register("j14_map_values", _research_cte(f"""WITH {_R_TRAIN}
SELECT row_key, {", ".join(f"round(cos(list_dot_product(x, {w.tolist()}) + {float(b)!r}) * {float((2 / _MAP.size) ** 0.5)!r}, 6) AS z{i}" for i, (w, b) in enumerate(zip(*_MAP.weights(), strict=True)))}
FROM (SELECT p.row_key, {_MAP_X} AS x FROM prepared p JOIN ({_R_SPLIT}) s ON s.row_key = p.row_key WHERE s.split = 'test')"""))
def j14_values(spark, sf):
    """The feature map over the scaled numeric inputs of the research test rows."""
    train, test = _research(spark, sf)
    s = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in RM.NUMERIC], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in RM.NUMERIC]).first()
    x = F.array(*[(F.col(c).cast("double") - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"]) for c in RM.NUMERIC])
    return test.select("row_key", _MAP.columns(x).alias("z")).select("row_key", *[F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(_MAP.size)])


# Closed forms in SQL, for groups g of training rows (gtr) and of rows to score (gte).
_X = [f"CAST({c} AS DOUBLE)" for c in RM.NUMERIC]
_P = len(_X)
_ONE_GROUP = f"""gtr AS (SELECT 0 AS g, * FROM tr),
gte AS (SELECT 0 AS g, p.* FROM prepared p JOIN ({_R_SPLIT}) s ON s.row_key = p.row_key WHERE s.split = 'test')"""
_FOLD_GROUPS = "rr AS (" + " UNION ALL ".join(f"""
SELECT {rep} AS repeat, (row_number() OVER (PARTITION BY price_category ORDER BY {stable_hash_sql("row_key", seed)}, row_key) - 1) % {RM.FOLDS} AS fold, *
FROM tr""" for rep, seed in enumerate(RM.REPEAT_SEEDS)) + f"""),
gtr AS (SELECT rr.repeat * {RM.FOLDS} + k.fold AS g, rr.* FROM rr JOIN (SELECT * FROM range({RM.FOLDS}) r(fold)) k ON rr.fold <> k.fold),
gte AS (SELECT repeat * {RM.FOLDS} + fold AS g, * FROM rr)"""
_MOMENTS = f"""mo AS (SELECT g, price_category AS c, count(*) AS n, [{", ".join(f"avg({x})" for x in _X)}] AS mu,
  [{", ".join(f"greatest(var_samp({x}), {RM.CF.FLAT})" for x in _X)}] AS va FROM gtr GROUP BY 1, 2),
tot AS (SELECT g, sum(n) AS total, count(*) AS k FROM mo GROUP BY 1)"""
# The pooled covariance beside the identity, reduced row by row to the inverse.
_LDA = f"""{_MOMENTS},
ce AS (SELECT g, {", ".join(f"{x} - avg({x}) OVER w AS d{i}" for i, x in enumerate(_X))} FROM gtr WINDOW w AS (PARTITION BY g, price_category)),
co AS (SELECT ce.g, [{", ".join("[" + ", ".join([f"sum(d{i} * d{j}) / any_value(total - k)" for j in range(_P)] + [f"{float(i == j)}" for j in range(_P)]) + "]" for i in range(_P))}] AS m
       FROM ce JOIN tot ON tot.g = ce.g GROUP BY 1),
inv AS (SELECT g, 1 AS turn, m FROM co UNION ALL
  SELECT g, turn + 1, list_transform(range(1, {_P + 1}), lambda i: CASE WHEN i = turn THEN list_transform(m[turn], lambda x: x / m[turn][turn])
    ELSE list_transform(range(1, {2 * _P + 1}), lambda j: m[i][j] - m[i][turn] * m[turn][j] / m[turn][turn]) END) FROM inv WHERE turn <= {_P}),
w AS (SELECT mo.g, c, n, mu, list_transform(m, lambda r: list_dot_product(r[{_P + 1}:], mu)) AS w FROM mo JOIN inv ON inv.g = mo.g AND turn = {_P + 1}),
sc AS (SELECT e.*, w.c, ln(w.n / total) - 0.5 * list_dot_product(mu, w) + list_dot_product(w, [{", ".join(_X)}]) AS s
       FROM gte e JOIN w ON w.g = e.g JOIN tot ON tot.g = e.g)"""
_NB = f"""{_MOMENTS},
lv AS (SELECT g, price_category AS c, room_type, count(*) AS m FROM gtr GROUP BY 1, 2, 3),
sc AS (SELECT e.*, mo.c, ln(mo.n / total) + ln(greatest(coalesce(lv.m, 0) / mo.n, {RM.CF.RARE})) + list_sum(list_transform(range(1, {_P + 1}),
         lambda i: -0.5 * ln(2 * pi() * va[i]) - 0.5 / va[i] * ([{", ".join(_X)}][i] - mu[i]) * ([{", ".join(_X)}][i] - mu[i]))) AS s
       FROM gte e JOIN mo ON mo.g = e.g JOIN tot ON tot.g = e.g LEFT JOIN lv ON lv.g = e.g AND lv.c = mo.c AND lv.room_type = e.room_type)"""
_SHARES = f"""pr AS (SELECT g, row_key, price_category AS label, c, round(exp(s - max(s) OVER u) / sum(exp(s - top)) OVER u, {RM.CF.DIGITS}) AS p
       FROM (SELECT *, max(s) OVER (PARTITION BY g, row_key) AS top FROM sc) WINDOW u AS (PARTITION BY g, row_key)),
ps AS (SELECT g, row_key, label, {", ".join(f"""coalesce(max(p) FILTER (WHERE c = '{t}'), 0) AS p{i}""" for i, t in enumerate(RESEARCH_TIER_ORDER))} FROM pr GROUP BY 1, 2, 3),
pd AS (SELECT *, CASE {" ".join(f"WHEN p{i} = greatest(p0, p1, p2) THEN '{t}'" for i, t in enumerate(RESEARCH_TIER_ORDER))} END AS prediction FROM ps)"""
_SCORED = "SELECT row_key, label, prediction, " + ", ".join(f'p{i} AS "score_{t}"' for i, t in enumerate(RESEARCH_TIER_ORDER)) + " FROM pd"


def _closed_form_sql(groups: str, model: str, result: str) -> str:
    return f"WITH RECURSIVE {_R_TRAIN},\n{groups},\n{model},\n{_SHARES}\n{result}"


@register("j11_linear_discriminant", _research_cte(_closed_form_sql(_ONE_GROUP, _LDA, _SCORED)))
def j11(spark, sf):
    """The research test rows by linear discriminant, scores rounded."""
    return RM.closed_form_test(*_research(spark, sf), "lda")


@register("j12_naive_bayes", _research_cte(_closed_form_sql(_ONE_GROUP, _NB, _SCORED)))
def j12(spark, sf):
    """The research test rows by Gaussian naive Bayes, scores rounded."""
    return RM.closed_form_test(*_research(spark, sf), "naive_bayes")


@register("j05_fold_statistics", _research_cte(f"WITH {_R_TRAIN},\n{_FOLD_GROUPS}\n" + " UNION ALL ".join(f"""
SELECT CAST(g // {RM.FOLDS} AS INTEGER) AS repeat, CAST(g % {RM.FOLDS} AS INTEGER) AS fold, price_category, '{c}' AS feature, count(*) AS n,
  round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(var_samp(CAST({c} AS DOUBLE)), 6) AS variance FROM gtr GROUP BY 1, 2, 3""" for c in RM.NUMERIC)))
def j05_statistics(spark, sf):
    return RM.fold_statistics(_research(spark, sf)[0])


_FOLD_F1 = " + ".join(f"""CASE WHEN count(*) FILTER (WHERE label = '{t}') + count(*) FILTER (WHERE prediction = '{t}') > 0
  THEN 2 * count(*) FILTER (WHERE label = '{t}' AND prediction = '{t}') / (count(*) FILTER (WHERE label = '{t}') + count(*) FILTER (WHERE prediction = '{t}')) ELSE 0 END"""
                      for t in RESEARCH_TIER_ORDER)


def _fold_scores_sql(name: str, rows: str) -> str:
    return f"""SELECT '{name}' AS model, CAST(g // {RM.FOLDS} AS INTEGER) AS repeat, CAST(g % {RM.FOLDS} AS INTEGER) AS fold, count(*) AS n,
  count(*) FILTER (WHERE label = prediction) / count(*) AS accuracy, ({_FOLD_F1}) / {len(RESEARCH_TIER_ORDER)} AS f1_macro FROM {rows} GROUP BY 2, 3"""


_MAJORITY_FOLDS = """mj AS (SELECT g, price_category AS prediction FROM gtr GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, price_category) = 1)"""


@register("j24_repeated_cv", _research_cte(" UNION ALL ".join("SELECT * FROM (" + x + ")" for x in [
    _closed_form_sql(_FOLD_GROUPS, _LDA, _fold_scores_sql("lda", "pd")), _closed_form_sql(_FOLD_GROUPS, _NB, _fold_scores_sql("naive_bayes", "pd")),
    f"WITH {_R_TRAIN},\n{_FOLD_GROUPS},\n{_MAJORITY_FOLDS}\n" + _fold_scores_sql(
        "baseline_majority", "(SELECT e.g, e.price_category AS label, mj.prediction FROM gte e JOIN mj ON mj.g = e.g)")])))
def j24_repeated(spark, sf):
    """Fifteen fits of each closed form and of the majority, from the sums of the folds."""
    return RM.repeated_scores(_research(spark, sf)[0])


# Neighbours: scaled coordinates and level weights in whole numbers, then every pair of test and training row.
_KNN_X = [f"CAST(floor(CAST({c} AS DOUBLE) / (SELECT {c} FROM sd) * {RM.GRID} + 0.5) AS BIGINT) AS x_{c}" for c in RM.NUMERIC]
_KNN_W = [f"coalesce((SELECT w FROM lv WHERE col = '{c}' AND level = p.{c}), 0) AS w_{c}, CAST({c} AS VARCHAR) AS c_{c}" for c in RM.CATEGORICAL]


def _knn_sql(rows: str, nearest: int) -> str:
    """CTEs up to nn: (query, label, k nearest {{squared, key, label}} in order); ``rows``: p with row_key, price_category, asks, holds, part."""
    apart = " + ".join([f"(q.x_{c} - t.x_{c}) * (q.x_{c} - t.x_{c})" for c in RM.NUMERIC]
                       + [f"CASE WHEN q.c_{c} <> t.c_{c} THEN q.w_{c} + t.w_{c} ELSE 0 END" for c in RM.CATEGORICAL])
    return f"""WITH {_R_TRAIN},
sd AS (SELECT count(*) AS n, {", ".join(f"stddev_samp(CAST({c} AS DOUBLE)) AS {c}" for c in RM.NUMERIC)} FROM tr),
lc AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS level, count(*) AS m FROM tr GROUP BY 2" for c in RM.CATEGORICAL)}),
lv AS (SELECT col, level, CASE WHEN row_number() OVER (PARTITION BY col ORDER BY level) = 1 OR m = n THEN 0
         ELSE CAST(floor({RM.GRID * RM.GRID} * (CAST(n * (n - 1) AS DOUBLE) / (m * (n - m))) + 0.5) AS BIGINT) END AS w FROM lc, sd),
placed AS (SELECT row_key, price_category, asks, holds, part, {", ".join(_KNN_X + _KNN_W)} FROM ({rows}) p),
nn AS (SELECT q.row_key, q.price_category AS label, q.part, list_sort(min({{'d': {apart}, 'key': t.row_key, 'label': t.price_category}}, {nearest})) AS near
       FROM placed q JOIN placed t ON q.asks AND t.holds AND (q.part IS NULL OR q.part <> t.part) GROUP BY 1, 2, 3)"""


_KNN_VOTES = f""",
v AS (SELECT row_key, label, part, k, list_transform(['{"', '".join(RESEARCH_TIER_ORDER)}'], lambda c: len(list_filter(near[1:k], lambda x: x.label = c))) AS n,
        CAST(least(k, len(near)) AS DOUBLE) AS total FROM nn, (VALUES {", ".join(f"({k})" for k in RM.NEIGHBOURS)}) t(k))"""
_KNN_BEST = "(['" + "', '".join(RESEARCH_TIER_ORDER) + "'])[list_position(n, list_max(n))]"


@register("j13_knn", _research_cte(_knn_sql(
    f"SELECT p.*, s.split = 'test' AS asks, s.split = 'train' AS holds, CAST(NULL AS INTEGER) AS part FROM prepared p JOIN ({_R_SPLIT}) s ON s.row_key = p.row_key",
    max(RM.NEIGHBOURS)) + _KNN_VOTES + f"""
SELECT row_key, label, k, {_KNN_BEST} AS prediction, {", ".join(f'n[{i}] / total AS "score_{c}"' for i, c in enumerate(RESEARCH_TIER_ORDER, 1))} FROM v"""))
def j13(spark, sf):
    """The research test rows classified by their k nearest training rows, for every k."""
    return RM.knn_predict(*_research(spark, sf))


# A rule stands in for a model, so that donors, copies and drops have an oracle.
_RULE = """CASE WHEN accommodates + coalesce(bedrooms, 0) >= 12 THEN 'Premium'
  WHEN room_type IN ('Hotel room', 'Private room') OR amenities_count >= 3 THEN 'Mid-Market' ELSE 'Budget' END"""
_RULE_INPUTS = ["accommodates", "bedrooms", "room_type", "amenities_count", "review_scores_rating"]


def _importance_sql(repeats: int, seed: int = 42) -> str:
    def rank(add):
        return f"row_number() OVER (ORDER BY {stable_hash_sql('id', seed + add)}, id)"

    def copy(c):
        columns = ", ".join(f"d.{x} AS {x}" if x == c else f"p.{x} AS {x}" for x in _RULE_INPUTS)
        return f"SELECT r, '{c}' AS feature, p.price_category, {columns} FROM te p JOIN dn d ON d.rk = p.pos"

    donors = " UNION ALL ".join(f"SELECT {r} AS r, {rank(IMP.DONOR + r)} AS rk, {', '.join(_RULE_INPUTS)} FROM te" for r in range(repeats))
    f1 = " + ".join(f"""CASE WHEN count(*) FILTER (WHERE price_category = '{t}') + count(*) FILTER (WHERE prediction = '{t}') > 0
      THEN 2 * count(*) FILTER (WHERE price_category = '{t}' AND prediction = '{t}')
        / (count(*) FILTER (WHERE price_category = '{t}') + count(*) FILTER (WHERE prediction = '{t}')) ELSE 0 END""" for t in TIER_ORDER)
    return f"""WITH s AS ({_split_rows_sql(0.2, 42)}),
te AS (SELECT p.id, p.price_category, {", ".join(f"p.{c}" for c in _RULE_INPUTS)}, row_number() OVER (ORDER BY {stable_hash_sql("p.id", seed + IMP.POSITION)}, p.id) AS pos
       FROM prepared p JOIN s ON s.id = p.id WHERE s.split = 'test'),
dn AS ({donors}),
c AS ({" UNION ALL ".join(copy(c) for c in _RULE_INPUTS)}),
per AS (SELECT r, feature, ({f1}) / 3 AS f1 FROM (SELECT *, {_RULE} AS prediction FROM c) GROUP BY 1, 2),
whole AS (SELECT ({f1}) / 3 AS f1 FROM (SELECT *, {_RULE} AS prediction FROM te))
SELECT feature, (SELECT f1 FROM whole) - avg(f1) AS importance, stddev_pop(f1) AS importance_std FROM per GROUP BY 1"""


@register("j25_permutation_importance", _prepared_cte(_importance_sql(5)))
def j25(spark, sf):
    """Permutation importance of the stand-in rule's inputs on the test rows."""
    return IMP.score_importance(lambda rows: rows.withColumn("prediction", F.expr(_RULE)), _RULE_INPUTS, _split_parts(spark, sf)[1])


@register("j25_model_importance")
def j25_model(spark, sf):
    """Permutation importance of a trained model: the logistic regression, kept where a process fitted it before."""
    return IMP.permutation_importance(_fitted(spark, sf, "logistic_regression"), _split_parts(spark, sf)[1], repeats=5)


# What the models with an oracle say of the research test rows, side by side.
_COMPARED = {"lda": "j11_linear_discriminant", "naive_bayes": "j12_naive_bayes", "baseline_random": "j07_random_baseline", "knn": "j13_knn"}
_COMPARED_K = 9


def _compared(query: str) -> str:
    return f" WHERE k = {_COMPARED_K}" if query == "j13_knn" else ""


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0e0 END"


def _comparison_columns() -> str:
    out = []
    for t in RESEARCH_TIER_ORDER:
        tp, real, said = _n(f"label = '{t}' AND prediction = '{t}'"), _n(f"label = '{t}'"), _n(f"prediction = '{t}'")
        out += [f'{_ratio(tp, real)} AS "sensitivity_{t}"', f'{_ratio(f"count(*) - {real} - {said} + {tp}", f"count(*) - {real}")} AS "specificity_{t}"',
                f'{_ratio(tp, said)} AS "precision_{t}"', f'{_ratio(f"2 * {tp}", f"{real} + {said}")} AS "f1_{t}"']
    return ", ".join(out)


_CHANCE = "(" + " + ".join(f"""{_n(f"label = '{t}'")} * {_n(f"prediction = '{t}'")}""" for t in RESEARCH_TIER_ORDER) + ") / (count(*) * count(*))"


@register("j31_model_comparison", "SELECT *, (" + " + ".join(f'"f1_{t}"' for t in RESEARCH_TIER_ORDER) + f""") / {len(RESEARCH_TIER_ORDER)} AS f1_macro,
  (accuracy - chance) / (1 - chance) AS kappa FROM (
SELECT model, count(*) AS n, {_n("label = prediction")} / count(*) AS accuracy, {_CHANCE} AS chance, {_comparison_columns()} FROM ("""
          + " UNION ALL ".join(f"SELECT '{m}' AS model, label, prediction FROM ({ORACLES[q]}){_compared(q)}" for m, q in _COMPARED.items()) + ") GROUP BY 1)")
def j31(spark, sf):
    """Accuracy, agreement beyond chance and each class's figures of the research models."""
    parts = [QUERIES[q](spark, sf) for q in _COMPARED.values()]
    parts = [p.where(F.col("k") == _COMPARED_K) if "k" in p.columns else p for p in parts]
    rows = reduce(DataFrame.unionByName, [p.select(F.lit(m).alias("model"), "label", "prediction") for m, p in zip(_COMPARED, parts, strict=True)])
    return ev.model_comparison(rows, RESEARCH_TIER_ORDER)


@register("a06_importance_report", _prepared_cte(_importance_sql(5)))
def a06(spark, sf):
    """Importances written as a JSON report and read back."""
    from tierscope.sources.files import read_json_report, write_json_report
    path = f"{checkpoint_dir(spark).rstrip('/')}/tierscope_reports/{uuid.uuid4().hex}"
    write_json_report(j25(spark, sf), path)
    return read_json_report(spark, path, "feature string, importance double, importance_std double")


# ----------------------------------------------------------------------------- sources
@register("a03_landed_raw_snapshot", with_base("SELECT * FROM listings_raw"))
def a03(spark, sf):
    """A3 + A4: the raw snapshot written partitioned by snapshot date, read back pruned."""
    return base.landed_raw(spark, sf)


@register("a05_report_confusion", _eval_sql("WITH " + _CM + " SELECT * FROM cm"))
def a05_confusion(spark, sf):
    """The nested metrics report written, read back and opened."""
    return _report(spark, sf).select(F.explode("confusion").alias("c")).select("c.label", "c.prediction", "c.n")


@register("a05_report_per_class", _eval_sql("WITH " + _PC + " SELECT class, precision, recall, f1, support FROM pc"))
def a05_per_class(spark, sf):
    return _report(spark, sf).select(F.explode("per_class").alias("c")).select("c.class", "c.precision", "c.recall", "c.f1", "c.support")


def _report(spark, sf) -> DataFrame:
    from tierscope.sources.files import read_json_report, write_json_report
    path = f"{checkpoint_dir(spark).rstrip('/')}/tierscope_reports/{uuid.uuid4().hex}"
    report = ev.model_report(_pred(spark, sf))
    write_json_report(report, path)
    return read_json_report(spark, path, report.schema)


@register("a01_csv_round_trip", with_base("SELECT * FROM cleaned"))
def a01(spark, sf):
    """The raw listings exported as CSV in landing order, read back by name, checked and cleaned."""
    from tierscope.operators.clean import clean_listings
    from tierscope.sources.files import read_listings_csv, require_columns, write_csv
    path = f"{checkpoint_dir(spark).rstrip('/')}/tierscope_csv/{uuid.uuid4().hex}"
    write_csv(base.landed_raw(spark, sf).orderBy("ingest_seq", "id").drop("ingest_seq"), path)
    back = read_listings_csv(spark, path)
    require_columns(back)
    return clean_listings(back)


@register("a12_scoring_requests", with_base("""
SELECT CAST(id AS VARCHAR) AS request_id, property_type, room_type, neighbourhood_cleansed, CAST(accommodates AS DOUBLE) AS accommodates,
  latitude, longitude, host_is_superhost, review_scores_rating FROM features"""))
def a12(spark, sf):
    """Requests written as JSON lines and read with their fixed schema."""
    from tierscope.sources.files import read_scoring_requests
    path = f"{checkpoint_dir(spark).rstrip('/')}/tierscope_requests/{uuid.uuid4().hex}"
    base.prepared(spark, sf).withColumn("request_id", F.col("id").cast("string")).write.json(path)
    return read_scoring_requests(spark, path).select(
        "request_id", "property_type", "room_type", "neighbourhood_cleansed", "accommodates", "latitude", "longitude",
        "host_is_superhost", "review_scores_rating")


_RATE = "40.0e0 + 25 * CAST(accommodates AS DOUBLE)"


@register("e16_request_standing", with_base(f"""
SELECT CAST(f.id AS VARCHAR) AS request_id, (SELECT count(*) FROM features c WHERE c.neighbourhood_cleansed IS NOT DISTINCT FROM f.neighbourhood_cleansed
    AND c.room_type IS NOT DISTINCT FROM f.room_type) AS n,
  (SELECT avg(CASE WHEN c.price_numeric < {_RATE.replace("accommodates", "f.accommodates")} THEN 1.0e0 ELSE 0.0e0 END) FROM features c
    WHERE c.neighbourhood_cleansed IS NOT DISTINCT FROM f.neighbourhood_cleansed AND c.room_type IS NOT DISTINCT FROM f.room_type) AS share_below
FROM features f"""))
def e16_requests(spark, sf):
    """E16 for scoring requests: a rate of its own for each, against the comparables' prices."""
    return mk.rate_standing(a12(spark, sf).withColumn("rate", F.expr(_RATE.replace("e0", "D"))), base.prepared(spark, sf))


_PLACES = 2000   # points of the grid below, spread by the golden ratio over the listings' region


@register("c9_nearest_of_many_points", with_base(f"""
WITH p AS (SELECT -34.1e0 + 0.5e0 * ((i * 0.6180339887498949e0) % 1) AS lat, 150.95e0 + 0.4e0 * (i / {_PLACES}.0e0) AS lon FROM range({_PLACES}) r(i)),
q AS (SELECT DISTINCT latitude, longitude FROM features WHERE latitude IS NOT NULL),
m AS (SELECT latitude, longitude, min(12742.0e0 * asin(sqrt(pow(sin(radians(lat - latitude) / 2), 2)
  + cos(radians(latitude)) * cos(radians(lat)) * pow(sin(radians(lon - longitude) / 2), 2)))) AS km FROM q, p GROUP BY 1, 2)
SELECT id, round(km, 6) AS nearest_km FROM features f LEFT JOIN m ON m.latitude = f.latitude AND m.longitude = f.longitude"""))
def c9_many(spark, sf):
    """C9 at large k: every listing's distance to the nearest of many points, by a widening grid."""
    from tierscope.operators.nearest_point import nearest_km
    i = F.col("id")
    points = spark.range(_PLACES).select((F.lit(-34.1) + 0.5 * ((i * 0.6180339887498949) % 1)).alias("lat"), (F.lit(150.95) + 0.4 * (i / float(_PLACES))).alias("lon"))
    return nearest_km(base.prepared(spark, sf).select("id", "latitude", "longitude"), points).select("id", F.round("nearest_km", 6).alias("nearest_km"))


_SLICE = "neighbourhood_cleansed = 'NATION_3' AND room_type = 'Private room'"


@register("b08_equality_slice", with_base(f"SELECT id, price_numeric FROM market WHERE {_SLICE}"))
def b08(spark, sf):
    return mk.slice_equal(base.market(spark, sf), neighbourhood_cleansed="NATION_3", room_type="Private room").select("id", "price_numeric")


@register("b13_empty_views", with_base(f"""
SELECT 'slice' AS view, EXISTS (SELECT 1 FROM market WHERE {_SLICE}) AS has_rows
UNION ALL SELECT 'nowhere', EXISTS (SELECT 1 FROM market WHERE neighbourhood_cleansed = 'nowhere')"""))
def b13(spark, sf):
    view = base.market(spark, sf)
    slices = {"slice": mk.slice_equal(view, neighbourhood_cleansed="NATION_3", room_type="Private room"),
              "nowhere": mk.slice_equal(view, neighbourhood_cleansed="nowhere")}
    return spark.createDataFrame([(k, mk.has_rows(v)) for k, v in slices.items()], "view string, has_rows boolean")


@register("e31_correlation_matrix", with_research(f"""
WITH cc AS (SELECT {_CORR_COLS} FROM research WHERE {" AND ".join(c + " IS NOT NULL" for c in pf.CORRELATION_FEATURES)})
""" + " UNION ALL ".join(f"SELECT '{a}' AS row, '{b}' AS col, corr({a}, {b}) AS value FROM cc"
                         for a in pf.CORRELATION_FEATURES for b in pf.CORRELATION_FEATURES)))
def e31_matrix(spark, sf):
    return pf.correlation_matrix(base.research_prepared(spark, sf))


_R_TYPES = "(SELECT [" + ", ".join(f"typeof({c})" for c in [*RM.NUMERIC, *RM.CATEGORICAL, "price_category"]) + "] AS t FROM research LIMIT 1)"


@register("e39_feature_types", with_research(f"""
SELECT 'numeric' AS kind, CAST(len(list_filter(t, lambda x: x NOT IN ('VARCHAR', 'BOOLEAN'))) AS INTEGER) AS columns FROM {_R_TYPES}
UNION ALL SELECT 'categorical', CAST(len(list_filter(t, lambda x: x IN ('VARCHAR', 'BOOLEAN'))) AS INTEGER) FROM {_R_TYPES}"""))
def e39(spark, sf):
    return pf.feature_type_summary(base.research_prepared(spark, sf).select(*RM.INPUTS))


# ----------------------------------------------------------------------------- reports + vocabularies
from tierscope.operators.features import frequent_levels, top_levels  # noqa: E402


@register("e38_retention", with_base(f"""
SELECT rows_in, rows_out, 100.0e0 * rows_out / greatest(rows_in, 1) AS pct_kept
FROM (SELECT (SELECT count(*) FROM listings_raw) AS rows_in, (SELECT count(*) FROM cleaned) AS rows_out)"""))
def e38(spark, sf):
    """From the counts that the cleaning job took in the pass that wrote its table."""
    return base.retention_report(spark, sf)


@register("b05_research_price_filter", with_research("""
SELECT rows_before, rows_after, rows_before - rows_after AS removed
FROM (SELECT (SELECT count(*) FROM r_priced) AS rows_before, (SELECT count(*) FROM r_filtered) AS rows_after)"""))
def b05(spark, sf):
    after = base.research_filtered(spark, sf).select(F.count(F.lit(1))).scalar()
    return (base.research_priced(spark, sf).select(F.count(F.lit(1)).alias("rows_before"))
            .select("rows_before", after.alias("rows_after"))
            .withColumn("removed", F.col("rows_before") - F.col("rows_after")))


@register("d03_property_type_vocabulary", with_base("SELECT property_type FROM vocab"))
def d03(spark, sf):
    return top_levels(base.cleaned(spark, sf), "property_type", 12)


@register("d04_frequent_levels", with_research("""
SELECT 'property_type' AS variable, property_type AS level FROM r_distinct WHERE property_type IS NOT NULL
GROUP BY 2 HAVING count(*) >= 30
UNION ALL
SELECT 'neighbourhood_cleansed', neighbourhood_cleansed FROM r_distinct WHERE neighbourhood_cleansed IS NOT NULL
GROUP BY 2 HAVING count(*) >= 20"""))
def d04(spark, sf):
    from tierscope.config import CONFIG
    rc = CONFIG.research
    distinct_rows = R.research_imputed(base.loaded_raw(spark, sf)).distinct()
    pt = frequent_levels(distinct_rows, "property_type", rc.property_type_min_count)
    nb = frequent_levels(distinct_rows, "neighbourhood_cleansed", rc.neighbourhood_min_count)
    return (pt.select(F.lit("property_type").alias("variable"), F.col("property_type").alias("level"))
              .unionByName(nb.select(F.lit("neighbourhood_cleansed").alias("variable"),
                                     F.col("neighbourhood_cleansed").alias("level"))))


_F13_COLS = [c for part in model_inputs() for c in part]


@register("f13_observed_feature_counts", with_base(
    "SELECT feature, observed, observed > 0 AS usable FROM (UNPIVOT (SELECT "
    + ", ".join(f"count({c}) AS {c}" for c in _F13_COLS)
    + " FROM features) ON " + ", ".join(_F13_COLS) + " INTO NAME feature VALUE observed)"))
def f13(spark, sf):
    f = base.prepared(spark, sf)
    counts = f.agg(*[F.count(F.col(c)).alias(c) for c in _F13_COLS])
    return (counts.unpivot([], _F13_COLS, "feature", "observed")
                  .withColumn("usable", F.col("observed") > 0))


@register("a05_metrics_report_round_trip", _eval_sql("WITH " + _PC + """
, s AS (SELECT sum(tp) AS tp_sum, sum(support) AS n, avg(precision) AS precision_macro, avg(recall) AS recall_macro,
          avg(f1) AS f1_macro, sum(support * (tp + fp)) AS pe_num FROM pc)
SELECT tp_sum / n AS accuracy, precision_macro, recall_macro, f1_macro,
  CASE WHEN pe_num / (n * n) < 1 THEN (tp_sum / n - pe_num / (n * n)) / (1 - pe_num / (n * n)) ELSE 0.0e0 END AS kappa,
  CAST(n AS BIGINT) AS n FROM s"""))
def a05(spark, sf):
    """A5 + A7: metrics written as a JSON report under the checkpoint folder and read back."""
    from tierscope.sources.files import read_json_report, write_json_report
    path = f"{checkpoint_dir(spark).rstrip('/')}/tierscope_reports/metrics"
    write_json_report(ev.summary_metrics(_pred(spark, sf)), path)
    return read_json_report(spark, path, "accuracy double, precision_macro double, recall_macro double, "
                                         "f1_macro double, kappa double, n long")



@register("c24_reviews_per_month_estimate", with_base(
    "SELECT id, round_even(CAST(number_of_reviews AS DOUBLE) / 24.0e0, 2) AS reviews_per_month_est FROM features"))
def c24(spark, sf):
    from tierscope.functions.parse import reviews_per_month_estimate
    return base.prepared(spark, sf).select(
        "id", reviews_per_month_estimate(F.col("number_of_reviews")).alias("reviews_per_month_est"))

"""DuckDB reference SQL for the correctness gate.

Each query in ``__spark_entry__.queries()`` has an independent DuckDB
formulation here.  They share a chain of CTEs that re-derive the raw
listings, the cleaned table and the feature table from the driver's
pre-registered views, written in DuckDB's own dialect.
"""

from __future__ import annotations

from tierscope.config import CONFIG, NA_STRINGS, RAW_COLUMNS, RESEARCH_POPULAR_AREAS
from tierscope.functions.amenities import flag_column
from tierscope.sources.tables import listings_raw_sql

_T = CONFIG.target
_F = CONFIG.features
_R = CONFIG.research

_STRING_RAW = ["price", "property_type", "room_type", "bathrooms_text", "amenities",
               "neighbourhood_cleansed", "host_is_superhost", "host_response_rate",
               "host_acceptance_rate", "host_identity_verified", "instant_bookable"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _num(x: str) -> str:
    return (f"(CASE WHEN regexp_full_match({x}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') "
            f"THEN CAST(trim({x}) AS DOUBLE) END)")


def _clip01(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(0.0e0, least(1.0e0, {x})) END)"


def _bool(x: str) -> str:
    return (f"(CASE WHEN lower({x}) IN ('t', 'true') THEN 1.0e0 "
            f"WHEN lower({x}) IN ('f', 'false') THEN 0.0e0 END)")


def _hav(lat: str, lon: str, lat0: float, lon0: float) -> str:
    return (f"(12742.0e0 * asin(sqrt(pow(sin((radians({lat0!r}e0) - radians({lat})) / 2), 2) "
            f"+ cos(radians({lat})) * cos(radians({lat0!r}e0)) "
            f"* pow(sin((radians({lon0!r}e0) - radians({lon})) / 2), 2))))")


def _tier(x: str, b: float, m: float, labels=("Budget", "Mid-Market", "Premium"), lowest=False) -> str:
    first = f"{x} >= 0" if lowest else f"{x} > 0"
    return (f"(CASE WHEN {first} AND {x} <= {b!r}e0 THEN '{labels[0]}' "
            f"WHEN {x} > {b!r}e0 AND {x} <= {m!r}e0 THEN '{labels[1]}' "
            f"WHEN {x} > {m!r}e0 THEN '{labels[2]}' END)")


NA = _in_list(NA_STRINGS)

LOADED = "SELECT id, ingest_seq, " + ", ".join(
    f"CASE WHEN {c} IN {NA} THEN NULL ELSE {c} END AS {c}" if c in _STRING_RAW else c
    for c in RAW_COLUMNS if c != "id") + " FROM listings_raw"

CLEANED_COLS = [c for c in RAW_COLUMNS if c not in ("price", "bathrooms_text")] + [
    "price_numeric", "price_category"]

TYPED = f"""
SELECT CAST(id AS BIGINT) AS id, CAST(ingest_seq AS BIGINT) AS ingest_seq,
  property_type, room_type, neighbourhood_cleansed, amenities,
  CAST(accommodates AS BIGINT) AS accommodates, CAST(bedrooms AS DOUBLE) AS bedrooms,
  CAST(beds AS DOUBLE) AS beds, CAST(latitude AS DOUBLE) AS latitude,
  CAST(longitude AS DOUBLE) AS longitude, CAST(host_listings_count AS DOUBLE) AS host_listings_count,
  CAST(review_scores_rating AS DOUBLE) AS review_scores_rating,
  CAST(reviews_per_month AS DOUBLE) AS reviews_per_month,
  CAST(number_of_reviews AS BIGINT) AS number_of_reviews,
  CAST(availability_365 AS BIGINT) AS availability_365,
  CAST(minimum_nights AS BIGINT) AS minimum_nights,
  {_num("regexp_replace(price, '[$,]', '', 'g')")} AS price_numeric,
  {_clip01(_num("regexp_replace(host_response_rate, '%+$', '')") + " / 100.0e0")} AS host_response_rate,
  {_clip01(_num("regexp_replace(host_acceptance_rate, '%+$', '')") + " / 100.0e0")} AS host_acceptance_rate,
  {_bool("host_is_superhost")} AS host_is_superhost,
  {_bool("host_identity_verified")} AS host_identity_verified,
  {_bool("instant_bookable")} AS instant_bookable,
  coalesce(CAST(bathrooms AS DOUBLE),
    {_num("nullif(regexp_extract(bathrooms_text, '(\\d+(?:\\.\\d+)?)', 1), '')")},
    CASE WHEN contains(lower(bathrooms_text), 'half') THEN 0.5e0 END) AS bathrooms
FROM loaded"""

CLEANED = f"""
SELECT {", ".join(c for c in CLEANED_COLS if c != "price_category")},
  {_tier("price_numeric", _T.budget_max, _T.mid_market_max)} AS price_category
FROM typed
WHERE price_numeric IS NOT NULL AND price_numeric BETWEEN {_T.min_price!r}e0 AND {_T.max_price!r}e0
QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq) = 1"""

ITEMS = """(CASE WHEN amenities IS NULL OR regexp_full_match(amenities, '\\s*') THEN []::VARCHAR[]
  WHEN NOT coalesce(json_valid(amenities), false) THEN
    list_filter(list_transform(string_split(trim(amenities, '[]{}'), ','), lambda t: trim(t, ' "')), lambda t: t <> '')
  WHEN json_type(amenities) = 'ARRAY' THEN from_json(amenities, '["VARCHAR"]')
  ELSE []::VARCHAR[] END)"""

_flags = ",\n  ".join(
    f"CAST(contains(lower(array_to_string(_items, ' | ')), {_q(a.lower())}) AS INTEGER) AS {flag_column(a)}"
    for a in _F.key_amenities)
_beach = "least(" + ", ".join(_hav("latitude", "longitude", la, lo) for _, la, lo in _F.beaches) + ")"
_base_cols = ", ".join(
    "CASE WHEN property_type IN (SELECT property_type FROM vocab) THEN property_type ELSE 'Other' END AS property_type"
    if c == "property_type" else c for c in CLEANED_COLS if c != "amenities")

VOCAB = f"""
SELECT property_type FROM cleaned WHERE property_type IS NOT NULL
GROUP BY property_type ORDER BY count(*) DESC, property_type LIMIT {_F.max_property_types}"""

FEATURES = f"""
SELECT {_base_cols},
  {_hav("latitude", "longitude", _F.cbd_lat, _F.cbd_lon)} AS distance_from_cbd_km,
  {_beach} AS distance_to_beach_km,
  CAST(coalesce(neighbourhood_cleansed IN {_in_list(_F.popular_areas)}, false) AS INTEGER) AS is_popular_area,
  CAST(len(_items) AS INTEGER) AS amenities_count,
  {_flags},
  CASE WHEN accommodates > 0 AND accommodates <= 2 THEN 'Small'
       WHEN accommodates > 2 AND accommodates <= 4 THEN 'Medium'
       WHEN accommodates > 4 AND accommodates <= 8 THEN 'Large'
       WHEN accommodates > 8 THEN 'Extra Large' END AS property_size,
  CASE WHEN host_listings_count <= 1 THEN 'Single Property'
       WHEN host_listings_count > 1 AND host_listings_count <= 5 THEN 'Small Portfolio'
       WHEN host_listings_count > 5 THEN 'Large Portfolio' END AS host_experience
FROM (SELECT *, {ITEMS} AS _items FROM cleaned)"""

# Market view with the dashboard's default filters: every non-null room
# type, price between int(min) and int(p99), every tier.
MARKET = """
SELECT * FROM features
WHERE room_type IS NOT NULL
  AND price_numeric BETWEEN (SELECT CAST(floor(min(price_numeric)) AS BIGINT) FROM features)
                        AND (SELECT CAST(floor(quantile_cont(price_numeric, 0.99)) AS BIGINT) FROM features)
  AND price_category IN ('Budget', 'Mid-Market', 'Premium')"""

CTES = {
    "listings_raw": listings_raw_sql(),
    "loaded": LOADED,
    "typed": TYPED,
    "cleaned": CLEANED,
    "vocab": VOCAB,
    "features": FEATURES,
    "market": MARKET,
}


def with_base(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query body with the shared CTE chain (plus optional extra CTEs)."""
    if body.lstrip().upper().startswith("WITH"):
        body = "SELECT * FROM (" + body + ")"
    ctes = dict(CTES)
    if extra:
        ctes.update(extra)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body


# ----------------------------------------------------------------------------- research
def pct_round2_sql(cnt: str, n: str) -> str:
    num = f"(CAST({cnt} AS BIGINT) * 10000)"
    q = f"({num} // {n})"
    r = f"({num} - {q} * {n})"
    return (f"(({q} + CASE WHEN 2 * {r} > {n} OR (2 * {r} = {n} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
            f" / 100.0e0)")


_RSTR = [c for c in _STRING_RAW]
R_LOADED = "SELECT id, ingest_seq, " + ", ".join(
    (f"CASE WHEN {c} IS NULL OR {c} IN ('', 'NA') THEN NULL WHEN {c} = 'N/A' THEN '' ELSE {c} END AS {c}"
     if c in _RSTR else c) for c in RAW_COLUMNS if c != "id") + " FROM listings_raw"

# Text columns whose every value is 't'/'f' become boolean; in this data
# that is host_identity_verified only (the others have missing values).
R_PRICED = f"""
SELECT id, price, property_type, room_type, accommodates, bedrooms, bathrooms, amenities,
  neighbourhood_cleansed, latitude, longitude, host_is_superhost, host_response_rate,
  host_listings_count, host_identity_verified = 't' AS host_identity_verified, review_scores_rating,
  number_of_reviews, reviews_per_month, availability_365, minimum_nights,
  {_num("regexp_replace(price, '[$,]', '', 'g')")} AS price_numeric,
  {_tier(_num("regexp_replace(price, '[$,]', '', 'g')"), _R.budget_max, _R.mid_market_max,
         ("Budget", "MidMarket", "Premium"), lowest=True)} AS price_category
FROM r_loaded"""

R_FILTERED = f"""
SELECT * REPLACE (host_is_superhost = 't' AS host_is_superhost,
  {_num("replace(host_response_rate, '%', '')")} / 100.0e0 AS host_response_rate),
  CAST(CASE WHEN amenities IS NULL OR amenities = '' OR amenities = '[]' THEN 0
       ELSE (length(amenities) - length(replace(amenities, '",', ''))) // 2 + 1 END AS INTEGER) AS amenities_count
FROM r_priced WHERE price_numeric > 0 AND price_numeric <= {_R.max_price!r}e0"""

R_IMPUTED = """
SELECT * REPLACE (coalesce(reviews_per_month, 0.0e0) AS reviews_per_month,
  coalesce(host_is_superhost, false) AS host_is_superhost,
  coalesce(host_listings_count, 1.0e0) AS host_listings_count,
  coalesce(host_identity_verified, false) AS host_identity_verified,
  coalesce(bathrooms, (SELECT median(bathrooms) FROM r_filtered)) AS bathrooms,
  coalesce(review_scores_rating, (SELECT median(review_scores_rating) FROM r_filtered)) AS review_scores_rating,
  coalesce(host_response_rate, (SELECT median(host_response_rate) FROM r_filtered)) AS host_response_rate,
  coalesce(bedrooms, CAST(ceil(accommodates / 2) AS DOUBLE)) AS bedrooms)
FROM r_filtered"""

R_DISTINCT = f"""
SELECT DISTINCT *,
  coalesce(neighbourhood_cleansed IN {_in_list(RESEARCH_POPULAR_AREAS)}, false) AS is_popular_area,
  sqrt(pow(latitude - ({_F.cbd_lat!r}e0), 2) + pow(longitude - ({_F.cbd_lon!r}e0), 2)) AS distance_from_cbd,
  CASE WHEN accommodates <= 2 THEN 'Small' WHEN accommodates <= 4 THEN 'Medium'
       WHEN accommodates <= 8 THEN 'Large' ELSE 'Extra Large' END AS property_size,
  CASE WHEN host_listings_count = 1 THEN 'Single Property' WHEN host_listings_count <= 5 THEN 'Small Portfolio'
       ELSE 'Large Portfolio' END AS host_experience,
  CASE WHEN availability_365 < 90 THEN 'Low' WHEN availability_365 < 180 THEN 'Medium' ELSE 'High' END
    AS availability_level
FROM r_imputed"""

R_FEATURES = f"""
SELECT * REPLACE (
  CASE WHEN property_type IS NULL THEN NULL
       WHEN property_type IN (SELECT property_type FROM r_distinct WHERE property_type IS NOT NULL
                              GROUP BY 1 HAVING count(*) >= {_R.property_type_min_count}) THEN property_type
       ELSE 'Other' END AS property_type,
  CASE WHEN neighbourhood_cleansed IS NULL THEN NULL
       WHEN neighbourhood_cleansed IN (SELECT neighbourhood_cleansed FROM r_distinct
                                       WHERE neighbourhood_cleansed IS NOT NULL GROUP BY 1
                                       HAVING count(*) >= {_R.neighbourhood_min_count}) THEN neighbourhood_cleansed
       ELSE 'Other' END AS neighbourhood_cleansed)
FROM r_distinct"""

RESEARCH_CTES = {
    "r_loaded": R_LOADED,
    "r_priced": R_PRICED,
    "r_filtered": R_FILTERED,
    "r_imputed": R_IMPUTED,
    "r_distinct": R_DISTINCT,
    "research": R_FEATURES,
}


def with_research(body: str, extra: dict[str, str] | None = None) -> str:
    return with_base(body, RESEARCH_CTES | (extra or {}))

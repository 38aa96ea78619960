"""Literal vectors for the column expressions (FIXTURES.md §4)."""

import math

from pyspark.sql import functions as F

from tierscope.config import CONFIG
from tierscope.functions.amenities import amenity_flags, parse_amenities
from tierscope.functions.buckets import host_experience, price_category, property_size
from tierscope.functions.geo import haversine_km
from tierscope.functions.parse import parse_bathrooms, parse_bool, parse_percent, parse_price, to_number


def _col(spark, values, ddl="v string"):
    return spark.createDataFrame([(v,) for v in values], ddl)


def test_parse_price(spark):
    df = _col(spark, ["$1,250.00", "$85.00", None, "300", "abc", "1d"])
    got = [r[0] for r in df.select(parse_price(F.col("v"))).collect()]
    assert got == [1250.0, 85.0, None, 300.0, None, None]


def test_parse_price_numeric_passthrough(spark):
    df = spark.createDataFrame([(12.5,), (None,)], "v double")
    assert [r[0] for r in df.select(parse_price(F.col("v"), is_text=False)).collect()] == [12.5, None]


def test_parse_percent(spark):
    df = _col(spark, ["95%", "100%", None, "0%", "150%", "N/A"])
    got = [r[0] for r in df.select(parse_percent(F.col("v"))).collect()]
    assert got == [0.95, 1.0, None, 0.0, 1.0, None]


def test_parse_percent_numeric_is_clipped_not_divided(spark):
    df = spark.createDataFrame([(0.5,), (3.0,), (None,)], "v double")
    assert [r[0] for r in df.select(parse_percent(F.col("v"), is_text=False)).collect()] == [0.5, 1.0, None]


def test_parse_bool(spark):
    df = _col(spark, ["t", "f", None, "TRUE", "false", "1.0"])
    assert [r[0] for r in df.select(parse_bool(F.col("v"))).collect()] == [1.0, 0.0, None, 1.0, 0.0, None]


def test_parse_bathrooms(spark):
    df = spark.createDataFrame([(2.0, "2 baths"), (None, "1.5 shared baths"), (None, "Shared half-bath"),
                                (None, None)], "n double, t string")
    got = [r[0] for r in df.select(parse_bathrooms(F.col("n"), F.col("t"))).collect()]
    assert got == [2.0, 1.5, 0.5, None]


def test_to_number_rejects_java_suffixes_and_nan(spark):
    df = _col(spark, [" 12 ", "1.5f", "NaN", "inf", "1e3", ".5"])
    assert [r[0] for r in df.select(to_number(F.col("v"))).collect()] == [12.0, None, None, None, 1000.0, 0.5]


def test_price_category_right_closed(spark):
    b, m = CONFIG.target.budget_max, CONFIG.target.mid_market_max
    df = spark.createDataFrame([(x,) for x in [b / 2, b, b + 0.01, m, m + 0.01, 3 * m]], "v double")
    got = [r[0] for r in df.select(price_category(F.col("v"), b, m)).collect()]
    assert got == ["Budget", "Budget", "Mid-Market", "Mid-Market", "Premium", "Premium"]


def test_haversine(spark):
    df = spark.createDataFrame([(-33.8688, 151.2093, -33.8688, 151.2093),
                                (-33.8688, 151.2093, -33.8908, 151.2743),
                                (-33.86767, 151.22497, -33.8688, 151.2093)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[0] == 0.0
    assert math.isclose(got[1], 6.480, abs_tol=0.01)
    assert 1.0 < got[2] < 2.0


def test_parse_amenities(spark):
    df = _col(spark, ['["Wifi", "Pool"]', "", None, "not json [Kitchen]", '{"a": 1}', "[]"])
    got = [r[0] for r in df.select(parse_amenities(F.col("v"))).collect()]
    assert got == [["Wifi", "Pool"], [], [], ["not json [Kitchen"], [], []]


def test_amenity_flags_substring_semantics(spark):
    df = _col(spark, ['["Dishwasher", "Pool table"]'])
    row = df.select(*amenity_flags(parse_amenities(F.col("v")), ["washer", "pool", "gym"])).first()
    assert (row.has_washer, row.has_pool, row.has_gym) == (1, 1, 0)
    exact = df.select(*amenity_flags(parse_amenities(F.col("v")), ["washer", "pool"], exact=True)).first()
    assert (exact.has_washer, exact.has_pool) == (0, 0)


def test_buckets(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5, 8, 9]], "v long")
    assert [r[0] for r in df.select(property_size(F.col("v"))).collect()] == [
        "Small", "Small", "Medium", "Medium", "Large", "Large", "Extra Large"]
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 5.0, 6.0, None]], "v double")
    assert [r[0] for r in df.select(host_experience(F.col("v"))).collect()] == [
        "Single Property", "Small Portfolio", "Small Portfolio", "Large Portfolio", None]


def test_malformed_amenities(spark):
    """Lists that are not valid JSON are cut at commas, whatever a lenient parser would make of them."""
    cases = {"['A, B', 'C']": ["'A", "B'", "'C'"], '["Wifi"] x': ['Wifi"] x'], '["a"], ["b"]': ["a\"]", '["b'], '1, 2': ["1", "2"],
             '["a", "b"]': ["a", "b"], '{"a": 1}': [], '"text"': [], "7": []}
    df = _col(spark, list(cases))
    assert {r.v: r.items_ for r in df.select("v", parse_amenities(F.col("v")).alias("items_")).collect()} == cases


def test_plain_amenities_are_not_parsed(spark, monkeypatch):
    """Lists of quoted items and plain words need no JSON parser; what is neither still goes through it."""
    cases = {'["Wifi", "Pool"]': ["Wifi", "Pool"], '["A, B"]': ["A, B"], '["a","",  "b"]': ["a", "", "b"], '[""]': [""],
             '["a", ", ", "b"]': ["a", ", ", "b"], "not json [Kitchen, Pool]": ["not json [Kitchen", "Pool"], "NaN": ["NaN"]}
    other = {'["a" "b"]': ['a" "b'], '["a","]': ["a"], '["\\u0041"]': ["A"], '["a", 1]': ["a", "1"], "true": [], "nullable": ["nullable"], '["a"] ': ["a"],
             '["]': []}
    df, rest = _col(spark, list(cases)), _col(spark, list(other))
    assert {r.v: r.i for r in rest.select("v", parse_amenities(F.col("v")).alias("i")).collect()} == other
    monkeypatch.setattr(F, "try_parse_json", lambda c: F.raise_error(F.lit("parsed")))
    assert {r.v: r.i for r in df.select("v", parse_amenities(F.col("v")).alias("i")).collect()} == cases


def test_typed_numbers_are_parsed_once(spark):
    from tierscope.config import RAW_COLUMNS
    from tierscope.operators.clean import typed_listings
    text = {"price", "bathrooms_text", "host_response_rate", "host_acceptance_rate", "amenities"}
    schema = ", ".join(f"{c} {'string' if c in text else 'double'}" for c in RAW_COLUMNS) + ", ingest_seq long"
    rows = [(i, "195%", "40%%", b) for i, b in enumerate(["1.5 baths", "Half-bath", "none", None])]
    df = spark.createDataFrame([tuple({"id": float(i), "ingest_seq": i, "price": "$1,200.00", "host_response_rate": r, "host_acceptance_rate": a,
                                       "bathrooms_text": b}.get(c) for c in [*RAW_COLUMNS, "ingest_seq"]) for i, r, a, b in rows], schema)
    typed = typed_listings(df)
    got = typed.select("price_numeric", "host_response_rate", "host_acceptance_rate", "bathrooms").collect()
    assert [tuple(r) for r in got] == [(1200.0, 1.0, 0.4, x) for x in (1.5, 0.5, None, None)]
    plan = typed.select("host_response_rate", "bathrooms")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(host_response_rate") == 1 and plan.count("regexp_extract(bathrooms_text") == 1

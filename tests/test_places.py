"""Nearest of many points, requests with a free rate, and retention counted while writing."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierscope.operators.nearest_point import nearest_km
from tierscope.plans import base
from tierscope.plans.market import rate_standing

SCHEMA = "id long, latitude double, longitude double"


def km(a, b, lat, lon):
    p, q = np.radians(a), np.radians(lat)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((np.radians(lon) - np.radians(b)) / 2) ** 2
    return 12742.0 * np.arcsin(np.minimum(np.sqrt(h), 1))


def compare(spark, places, points, level=13):
    out = nearest_km(spark.createDataFrame(places, SCHEMA), spark.createDataFrame(points, "lat double, lon double"), level=level).collect()
    assert len(out) == len(places)
    lat, lon = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    own = {p[0]: p for p in places}
    for r in out:
        _, a, b = own[r["id"]]
        if a is None or b is None:
            assert r["nearest_km"] is None
        else:
            assert math.isclose(r["nearest_km"], km(a, b, lat, lon).min(), rel_tol=1e-9, abs_tol=1e-6)


def test_a_hundred_thousand_points(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-34.1, -33.6), rng.uniform(150.9, 151.4)) for _ in range(100_000)]
    places = [(i, rng.uniform(-34.2, -33.5), rng.uniform(150.8, 151.5)) for i in range(150)] + [(900, None, 151.0), (901, -34.0, None)]
    compare(spark, places, points)


@pytest.mark.parametrize("level", [13, 6, 2])
def test_anywhere_on_the_globe(spark, level):
    rng = random.Random(2)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(89.9, 10.0), (-89.99, -170.0), (0.0, 180.0)]
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(120)]
    places += [(500, 90.0, 0.0), (501, -90.0, 33.0), (502, 89.95, -170.0), (503, 0.01, -179.99), (504, 0.0, 179.99), (505, 45.0, 0.0), (506, 0.0, 0.0)]
    compare(spark, places, points, level)


def test_one_far_point_and_equal_places(spark):
    compare(spark, [(i, 10.0, 20.0) for i in range(40)] + [(99, -33.0, 151.0)], [(-33.0, 151.0)] * 30)
    empty = nearest_km(spark.createDataFrame([(1, 1.0, 1.0)], SCHEMA), spark.createDataFrame([], "lat double, lon double")).first()
    assert empty["nearest_km"] is None


def test_no_cross_join(spark):
    points = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "lat double, lon double")
    plan = nearest_km(spark.createDataFrame([(1, 1.0, 1.0)], SCHEMA), points)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_rates_against_comparables(spark):
    rng = random.Random(3)
    comps = [(rng.choice(["n1", "n2", None]), rng.choice(["r1", None]), rng.choice([float(rng.randint(10, 40)), None])) for _ in range(300)]
    asked = [(f"q{i}", rng.choice(["n1", "n2", None, "n9"]), rng.choice(["r1", None]), rng.choice([rng.uniform(5, 45), float(rng.randint(10, 40)), None])) for i in range(200)]
    out = {r["request_id"]: r for r in rate_standing(
        spark.createDataFrame(asked, "request_id string, neighbourhood_cleansed string, room_type string, rate double"),
        spark.createDataFrame(comps, "neighbourhood_cleansed string, room_type string, price_numeric double")).collect()}
    assert len(out) == 200
    for q, hood, room, rate in asked:
        prices = [p for a, b, p in comps if a == hood and b == room and p is not None]
        assert out[q]["n"] == len(prices)
        if rate is None or not prices:
            assert out[q]["share_below"] is None
        else:
            assert abs(out[q]["share_below"] - sum(p < rate for p in prices) / len(prices)) < 1e-12


def test_retention_is_counted_while_the_table_is_written(spark):
    from conftest import SF_SMALL
    from tierscope.operators.clean import retention
    assert base.retention_report(spark, SF_SMALL).collect() == retention(base.loaded(spark, SF_SMALL)).collect()
    assert base.landed_cleaned(spark, SF_SMALL).agg(F.count("*")).first()[0] == base.retention_report(spark, SF_SMALL).first()["rows_out"]

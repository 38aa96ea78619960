"""Distance to the nearest of any number of points, over a grid that widens.

Cells are ``360 / 2 ** level`` degrees wide.  In each round a place is joined
with the points of its own and the eight cells around it, and it is done when
the best distance is not above the distance to the rim of that block: no
point outside can be nearer.  The places left go on with cells twice as wide,
until the block is the globe.  Every join is on cells; equal places are asked
once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.config import EARTH_RADIUS_KM
from tierscope.functions.geo import haversine_km
from tierscope.session import checkpoint_dir

LEVEL = 13   # cells of 0.044 degrees, about five kilometres


def _cells(level: int) -> tuple[float, int]:
    return 360 / 2 ** level, 2 ** level


def _rim_km(lat, lon, level: int):
    """Least distance from a place to what lies outside its block of nine cells (null: nothing does)."""
    size, around = _cells(level)
    row, col = F.floor(lat / size), F.floor(lon / size)
    by_lat = F.when((row - 1) * size > -90, F.radians(lat - (row - 1) * size)), F.when((row + 2) * size < 90, F.radians((row + 2) * size - lat))
    east_west = F.least(lon - (col - 1) * size, (col + 2) * size - lon)
    # A meridian further than a quarter turn is nearest at the pole.
    by_lon = F.when(east_west < 90, F.asin(F.least(F.cos(F.radians(lat)) * F.sin(F.radians(east_west)), F.lit(1.0)))).otherwise(
        math.pi / 2 - F.abs(F.radians(lat)))
    parts = [*by_lat, by_lon if around > 3 else F.lit(None).cast("double")]
    return F.least(*parts) * EARTH_RADIUS_KM


def nearest_km(df: DataFrame, points: DataFrame, lat: str = "latitude", lon: str = "longitude", out: str = "nearest_km", level: int = LEVEL) -> DataFrame:
    """``df`` with the distance to the nearest of ``points`` (lat, lon); null without a place or without points."""
    checkpoint_dir(df.sparkSession)
    targets = points.select(F.col("lat").cast("double").alias("_plat"), F.col("lon").cast("double").alias("_plon")).dropna().distinct().checkpoint()
    left = df.select(F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).dropna().distinct().checkpoint()
    found = None
    # At level 1 the cells are half the globe: the block is all of it.
    for step in range(level, 0, -1):
        size, around = _cells(step)

        def col(x, around=around, size=size):
            return F.pmod(F.floor(x / size), F.lit(around))

        block = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(*[
            F.struct((F.floor(F.col("_lat") / size) + a).alias("row"), F.pmod(F.floor(F.col("_lon") / size) + b, F.lit(around)).alias("col"))
            for b in (-1, 0, 1)]) for a in (-1, 0, 1)]))))
        asked = left.select("_lat", "_lon", block.alias("cell")).select("_lat", "_lon", "cell.row", "cell.col")
        known = targets.select(F.floor(F.col("_plat") / size).alias("row"), col(F.col("_plon")).alias("col"), "_plat", "_plon")
        best = asked.join(known, ["row", "col"]).groupBy("_lat", "_lon").agg(
            F.min(haversine_km(F.col("_lat"), F.col("_lon"), F.col("_plat"), F.col("_plon"))).alias("km"))
        rim = _rim_km(F.col("_lat"), F.col("_lon"), step)
        judged = left.join(best, ["_lat", "_lon"], "left").withColumn(
            "sure", F.col("km").isNotNull() & (rim.isNull() | (F.col("km") <= rim * (1 - 1e-9)))).checkpoint()
        done = judged.filter("sure").select("_lat", "_lon", "km")
        found = done if found is None else found.unionByName(done)
        left = judged.filter("not sure").select("_lat", "_lon")
        if left.isEmpty():
            break
    return df.join(found.select(F.col("_lat").alias("_a"), F.col("_lon").alias("_b"), F.col("km").alias(out)),
                   (F.col(lat).cast("double") == F.col("_a")) & (F.col(lon).cast("double") == F.col("_b")), "left").drop("_a", "_b")

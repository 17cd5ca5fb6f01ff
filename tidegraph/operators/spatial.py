"""Distances on a sphere and boxes of latitude and longitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
EARTH_NM = 3440.065


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of ``radius``; null if a coordinate is null."""
    a, b, c, d = (x if isinstance(x, Column) else F.lit(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((F.radians(c) - F.radians(a)) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin((F.radians(d) - F.radians(b)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def within_box(lat: str, lon: str, south: float, west: float, north: float, east: float) -> Column:
    return F.col(lat).between(south, north) & F.col(lon).between(west, east)


def within_distance(lat: str, lon: str, to_lat: float, to_lon: float, metres: float) -> Column:
    """Closer than ``metres``; a band of latitudes is tested first, so the scan can skip."""
    band = metres / EARTH_M * 57.29577951308232 * 1.000001
    return F.col(lat).between(to_lat - band, to_lat + band) & (haversine(F.col(lat), F.col(lon), to_lat, to_lon) < metres)


def nearby(df: DataFrame, lat: str, lon: str, to_lat: float, to_lon: float, km: float, k: int = 20, last: str = "id") -> DataFrame:
    near = df.where(within_distance(lat, lon, to_lat, to_lon, km * 1000))
    return near.withColumn("distance_km", F.round(haversine(F.col(lat), F.col(lon), to_lat, to_lon) / 1000, 2)).orderBy("distance_km", last).limit(k)


def distance_join(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs of ``left`` (id, lat, lon) and ``right`` (id, lat, lon) closer than ``metres``.

    An equi-join on latitude bands and, but near the poles, longitude cells; each
    right row is put into the cells that its circle touches.
    """
    deg = metres / EARTH_M * 57.29577951308232 * 1.000001
    band = lambda c: F.floor(c / deg).cast("long")
    l = left.select(F.col("id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("oa"), band(F.col("lat")).alias("band"))  # noqa: E741
    r = right.select(F.col("id").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), F.explode(F.sequence(band(F.col("lat")) - 1, band(F.col("lat")) + 1)).alias("band"))
    wide = lambda band_: F.least(F.lit(360.0), F.lit(deg) / F.greatest(F.lit(1e-6), F.cos(F.radians(F.greatest(F.abs(band_ * deg), F.abs((band_ + 1) * deg))))))
    cells = F.floor(F.lit(360.0) / wide(F.col("band"))).cast("long")
    cell = lambda c: F.pmod(F.floor((c + 180.0) / (F.lit(360.0) / cells)).cast("long"), cells)
    l = l.withColumn("cell", F.when(cells > 3, cell(F.col("oa"))).otherwise(F.lit(0).cast("long")))  # noqa: E741
    at = cell(F.col("ob"))
    around = F.array_distinct(F.array(F.pmod(at - 1, cells), at, F.pmod(at + 1, cells)))
    r = r.withColumn("cell", F.explode(F.when(cells > 3, around).otherwise(F.array(F.lit(0).cast("long")))))
    d = haversine(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob"))
    return l.join(r, ["band", "cell"]).withColumn("metres", d).where(F.col("metres") < metres).select("a", "b", "metres")

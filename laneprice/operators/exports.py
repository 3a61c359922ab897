"""Column-wise exports: places and outlines as integer deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vertices of a ring that an export keeps, at least.
LEAST_RING = 4


def place_columns(places: DataFrame, decimals: int) -> DataFrame:
    """state, names, d_lat, d_lon: places (name, state, lat, lon, population) of each state, largest first (ties by name, lat, lon).

    Coordinates are rounded half even to decimals and given as differences to the place before, the first whole,
    so that every state can be read by itself.
    """
    scale = 10**decimals
    order = Window.partitionBy("state").orderBy(F.desc("population"), "name", "lat", "lon")
    rows = places.withColumn("seq", F.row_number().over(order))
    for c in ("lat", "lon"):
        rows = rows.withColumn(f"g_{c}", F.rint(F.col(c) * scale).cast("long"))
    rows = rows.select("state", "seq", "name", *((F.col(f"g_{c}") - F.coalesce(F.lag(f"g_{c}").over(order), F.lit(0))).alias(f"d_{c}") for c in ("lat", "lon")))
    listed = F.array_sort(F.collect_list(F.struct("seq", "name", "d_lat", "d_lon")))
    held = rows.groupBy("state").agg(listed.alias("r"))
    return held.select("state", *(F.col(f"r.{c}").alias(a) for c, a in (("name", "names"), ("d_lat", "d_lat"), ("d_lon", "d_lon"))))


def decode_place_columns(columns: DataFrame, decimals: int) -> DataFrame:
    """state, seq, name, lat, lon back from place_columns()."""
    rows = columns.select("state", F.posexplode(F.arrays_zip("names", "d_lat", "d_lon")).alias("i", "p"))
    sofar = Window.partitionBy("state").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: (F.sum(f"p.d_{c}").over(sofar) / 10**decimals).alias(c)
    return rows.select("state", (F.col("i") + 1).alias("seq"), F.col("p.names").alias("name"), at("lat"), at("lon"))


def _deltas(points: Column) -> Column:
    """Grid points as differences to the one before, the first whole; points equal to the one before go."""
    once = F.filter(points, lambda p, i: (i == 0) | (F.get(points, i - 1) != p))
    return F.transform(once, lambda p, i: F.struct((p["x"] - F.when(i > 0, F.get(once, i - 1)["x"]).otherwise(0)).alias("dx"), (p["y"] - F.when(i > 0, F.get(once, i - 1)["y"]).otherwise(0)).alias("dy")))


def polygon_columns(shapes: DataFrame, decimals: int) -> DataFrame:
    """code, polygons, west, south, east, north of shapes (code, poly, rings array<array<struct<x, y>>>).

    polygons holds the rings of every polygon, in order of poly, as integer deltas (halves up); rings of fewer than
    LEAST_RING points go. The box is that of the rounded rings.
    """
    scale = 10**decimals
    grid = lambda ring: F.transform(ring, lambda p: F.struct(F.floor(p["x"] * scale + 0.5).cast("long").alias("x"), F.floor(p["y"] * scale + 0.5).cast("long").alias("y")))
    rings = F.filter(F.transform("rings", grid), lambda r: F.size(_deltas(r)) >= LEAST_RING)
    rows = shapes.select("code", "poly", rings.alias("rings"))
    points = F.flatten("rings")
    sides = [F.array_min(F.transform(points, lambda p: p["x"])), F.array_min(F.transform(points, lambda p: p["y"])), F.array_max(F.transform(points, lambda p: p["x"])), F.array_max(F.transform(points, lambda p: p["y"]))]
    rows = rows.select("code", "poly", F.transform("rings", _deltas).alias("rings"), *(s.alias(n) for s, n in zip(sides, ("west", "south", "east", "north"), strict=True)))
    box = [(f(n) / scale).alias(n) for f, n in ((F.min, "west"), (F.min, "south"), (F.max, "east"), (F.max, "north"))]
    return rows.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("poly", "rings"))), lambda p: p["rings"]).alias("polygons"), *box)

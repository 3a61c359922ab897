"""Distances to outlines, and what lies near a border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, tags

#: Kilometres of a degree of latitude that outline distances use, and of border posts to the outline.
DEGREE_KM, BORDER_KM = 110.57, 10.0


def border_distance(points: DataFrame, outline: DataFrame) -> DataFrame:
    """id, km: distance of points (id, lat, lon) to the nearest segment of outline (x1, y1, x2, y2), infinite if none is near.

    Segments count in every whole degree that their box touches, points meet those of their own degree and
    of the eight around it; each segment is sent to the degrees around it, points stay single. Degrees of
    longitude go round the globe.
    """
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b)) - 1, F.floor(F.greatest(a, b)) + 1))
    cells = outline.withColumn("cx", reach("x1", "x2")).withColumn("cy", reach("y1", "y2")).withColumn("cx", F.pmod("cx", F.lit(360)))
    at = points.select("id", "lat", "lon", F.pmod(F.floor("lon"), F.lit(360)).alias("cx"), F.floor("lat").alias("cy"))
    near = at.join(cells, ["cx", "cy"]).withColumn("km", geo.segment_km("lat", "lon", "y1", "x1", "y2", "x2", DEGREE_KM))
    found = near.groupBy("id").agg(F.min("km").alias("km"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("km", F.lit(float("inf"))).alias("km"))


def away_from_border(candidates: DataFrame, outline: DataFrame, border_km: float = BORDER_KM) -> DataFrame:
    """candidates (id, lat, lon, name, gov, ...) without those that are named like a customs post, have no public operator and lie near the outline."""
    posted = F.coalesce(tags.says(F.col("name"), tags.BORDER_NAME) & ~tags.says(F.col("name"), "weigh|scale"), F.lit(False)) & ~F.coalesce("gov", F.lit(False))
    near = border_distance(candidates.where(posted).select("id", "lat", "lon"), outline).where(F.col("km") <= border_km)
    return candidates.join(near.select("id"), "id", "left_anti")

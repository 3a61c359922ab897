"""Joins of points with points, cells and polygons by equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from .durable import cut

#: Metres of a degree of latitude, rounded down so that cells reach far enough.
DEGREE_M = 110_000.0


#: Edges (about 60 bytes each) that may be broadcast to points; more are met in salted parts of a row of cells.
BROADCAST_EDGES, SALTS = 200_000, 32


def grid_columns(y: Column, tall: float) -> Column:
    """How many cells the row y has, whose cells are tall degrees high and at least as far around; one where they would be wider than 20 degrees."""
    far = F.least(F.lit(90.0), (F.greatest(F.abs(y), F.abs(y + 1)) + 1) * tall)
    wide = tall / F.cos(F.radians(far))
    return F.when((wide > 0) & (wide < 20), F.floor(360 / wide)).otherwise(1).cast("long")


def grid_column(lon: str, n: Column) -> Column:
    """The cell of a longitude in a row of n."""
    return F.least(F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / 360 * n), n - 1)


def distance_join(a: DataFrame, b: DataFrame, radius_m: float, by: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (id_a, id_b, metres) of points (id, lat, lon) within radius_m of each other, anywhere on the globe.

    Places are met once, whatever number of points they hold (see near_places); the points of a pair of places
    follow by equi-joins. Columns in by must be equal; columns in carry follow as name_a and name_b.
    """
    side = lambda df, s: df.select(*by, *(F.col(c).alias(f"{c}_{s}") for c in dict.fromkeys(("id", "lat", "lon", *carry))))
    found = near_places(a.select(*by, "lat", "lon").distinct(), b.select(*by, "lat", "lon").distinct(), radius_m, by)
    for df, s in ((a, "a"), (b, "b")):
        found = found.join(side(df, s).hint("merge"), [*by, f"lat_{s}", f"lon_{s}"])
    kept = [f"{c}_{s}" for c in carry for s in "ab"]
    return found.select(*by, "id_a", "id_b", *kept, "metres")


def near_places(a: DataFrame, b: DataFrame, radius_m: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (by, lat_a, lon_a, lat_b, lon_b, metres) of places (by, lat, lon) within radius_m of each other.

    Places of a fall into one grid cell, places of b into it and its neighbours. Cells are a radius tall; a row
    has as many around the globe as are a radius wide at its far side, one near the poles. The joins are merged:
    a plan's estimate knows nothing of the nine cells of a place, so it would broadcast what a driver can't hold.
    """
    tall = radius_m / DEGREE_M
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    columns = lambda y: grid_columns(y, tall)
    side = lambda df, s: df.select(*by, F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))

    left = side(a, "a").withColumn("y", F.floor(F.col("lat_a") / tall))
    left = left.withColumn("x", grid_column("lon_a", columns(F.col("y"))))
    right = side(b, "b").withColumn("y", F.explode(F.transform(near, lambda d: F.floor(F.col("lat_b") / tall) + d)))
    n = columns(F.col("y"))
    right = right.withColumn("x", F.explode(F.array_distinct(F.transform(near, lambda d: F.pmod(grid_column("lon_b", n) + d, n)))))
    metres = haversine_m("lat_a", "lon_a", "lat_b", "lon_b")
    return left.join(right.hint("merge"), [*by, "y", "x"]).select(*by, "lat_a", "lon_a", "lat_b", "lon_b", metres.alias("metres")).where(F.col("metres") <= radius_m)


def points_near(points: DataFrame, others: DataFrame, radius_m: float) -> DataFrame:
    """The points (lat, lon, any columns) that have one of others (lat, lon) within radius_m."""
    met = near_places(points.select("lat", "lon").distinct(), others.select("lat", "lon").distinct(), radius_m)
    return points.join(met.select(F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon")).distinct(), ["lat", "lon"], "left_semi")


def cover_with_cells(edges: DataFrame, size: float) -> DataFrame:
    """edges (code, ring, is_hole, x1, y1, x2, y2) once for every row of cells that they cross."""
    return edges.withColumn("cell_y", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size))))


def polygon_cells(edges: DataFrame, size: float) -> DataFrame:
    """code, poly, cell_y, cell_x, inside: the cells that an edge of a polygon touches (inside false), and those that lie in it.

    An edge touches the cells of its stretch of every row. In a row the middles of cells are in a ring between an odd
    crossing of their line and the next, so rings fill their cells row by row, not by a test of each.
    """
    hair = 1e-9
    rows = edges.withColumn("cell_y", F.explode(F.sequence(F.floor((F.least("y1", "y2") - hair) / size), F.floor((F.greatest("y1", "y2") + hair) / size))))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)))
    low, high = F.greatest(F.least("y1", "y2"), F.col("cell_y") * size), F.least(F.greatest("y1", "y2"), (F.col("cell_y") + 1) * size)
    level = F.col("y1") == F.col("y2")
    ends = (F.when(level, F.col("x1")).otherwise(at(low)), F.when(level, F.col("x2")).otherwise(at(high)))
    touched = rows.withColumn("cell_x", F.explode(F.sequence(F.floor((F.least(*ends) - hair) / size), F.floor((F.greatest(*ends) + hair) / size)))).select("code", "poly", "cell_y", "cell_x").distinct()
    touched = cut(touched)
    middle = (F.col("cell_y") + 0.5) * size
    crossings = rows.where((F.col("y1") > middle) != (F.col("y2") > middle)).groupBy("code", "poly", "ring", "is_hole", "cell_y").agg(F.sort_array(F.collect_list(at(middle))).alias("xs"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.get("xs", i).alias("w"), F.get("xs", i + 1).alias("e"))))
    spans = crossings.where(F.size("xs") >= 2).select("code", "poly", "is_hole", "cell_y", pairs.alias("p")).select("*", F.ceil(F.col("p.w") / size - 0.5).alias("a"), (F.ceil(F.col("p.e") / size - 0.5) - 1).alias("b")).where("a <= b")
    filled = spans.withColumn("cell_x", F.explode(F.sequence("a", "b"))).groupBy("code", "poly", "cell_y", "cell_x").agg(F.bool_or(~F.col("is_hole")).alias("outer"), F.bool_or("is_hole").alias("hole"))
    filled = filled.where(F.col("outer") & ~F.col("hole")).join(touched, ["code", "poly", "cell_y", "cell_x"], "left_anti")
    return touched.withColumn("inside", F.lit(False)).unionByName(filled.select("code", "poly", "cell_y", "cell_x", F.lit(True).alias("inside")))


def locate(points: DataFrame, edges: DataFrame, size: float = 1.0) -> DataFrame:
    """id, code: the polygon with the smallest code that holds the point: inside its outer ring and in no hole.

    Points of a cell that lies in a polygon have its code by the cell alone. Those of cells that a polygon's edges
    touch meet that polygon's edges in their row of cells: a ray to the east crosses a ring an odd number of times. Few
    cells and edges are broadcast, so points stay where they are; with more, the points of a row are dealt into
    SALTS parts. Points in no polygon are left out. Edges may have poly, the polygon of the code they belong to.
    """
    edges = edges if "poly" in edges.columns else edges.withColumn("poly", F.lit(0))
    cells, covered = cut(polygon_cells(edges, size)), cover_with_cells(edges, size)
    rays = points.select("id", "lat", "lon", F.floor(F.col("lat") / size).alias("cell_y"), F.floor(F.col("lon") / size).alias("cell_x"))
    placed = rays.join(F.broadcast(cells) if cells.count() <= BROADCAST_EDGES else cells, ["cell_y", "cell_x"])
    near = placed.where("NOT inside").select("id", "lat", "lon", "cell_y", "code", "poly")
    keys = ["cell_y", "code", "poly"]
    if covered.count() <= BROADCAST_EDGES:
        met = near.join(F.broadcast(covered), keys)
    else:
        salted = covered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = near.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"])
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    odd = met.where(crosses).groupBy("id", "code", "poly", "ring", "is_hole").agg((F.count("*") % 2 == 1).alias("odd")).where("odd")
    held = odd.groupBy("id", "code", "poly").agg(F.bool_or(~F.col("is_hole")).alias("outer"), F.bool_or("is_hole").alias("hole"))
    held = held.where(F.col("outer") & ~F.col("hole")).select("id", "code").unionByName(placed.where("inside").select("id", "code"))
    return held.groupBy("id").agg(F.min("code").alias("code"))


def locate_near(points: DataFrame, edges: DataFrame, tolerance_km: float, size: float = 1.0) -> DataFrame:
    """id, code as locate() gives it; points in no polygon take that of the first of eight probes tolerance_km away: N, S, E, W, NE, NW, SE, SW."""
    inside = cut(locate(points, edges, size))
    missed = points.join(inside, "id", "left_anti").select("id", "lat", "lon")
    up, right = F.lit(tolerance_km / 110.57), tolerance_km / (111.32 * F.cos(F.radians("lat")))
    ways = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))
    probes = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("lat") + up * y).alias("lat"), (F.col("lon") + right * x).alias("lon")) for k, (y, x) in enumerate(ways)))
    tried = missed.select("id", F.explode(probes).alias("p")).select(F.struct("id", "p.k").alias("id"), "p.lat", "p.lon")
    found = locate(tried, edges, size).groupBy(F.col("id.id").alias("id")).agg(F.min_by("code", F.col("id.k")).alias("code"))
    return inside.unionByName(found)


def coverage_share(official: DataFrame, known: DataFrame, group: str, radius_m: float) -> DataFrame:
    """Per group and in all (group null): official points, those with a known point near, and their share to 3 decimals."""
    matched = points_near(official, known, radius_m).select("id").distinct().withColumn("hit", F.lit(1))
    rows = official.join(matched.hint("merge"), "id", "left").rollup(group).agg(F.count("*").alias("official"), F.count("hit").alias("matched"))
    return rows.withColumn("share", F.round(F.col("matched") / F.col("official"), 3))


def in_box(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)

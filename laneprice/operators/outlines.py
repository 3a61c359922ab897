"""Outlines that share borders, thinned so that neighbours still fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import simplify_batches
from .durable import cut

#: Vertices that a task takes at most, where no ring has more: tasks that sort and gather are as many as the vertices need.
TASK_VERTICES = 250_000


def ring_area(points: Column) -> Column:
    """Unsigned area of an open ring (array<struct<x, y>>)."""
    ahead = lambda i: F.get(points, (i + 1) % F.size(points))
    parts = F.transform(points, lambda p, i: p["x"] * ahead(i)["y"] - ahead(i)["x"] * p["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)) / 2


def _turned(points: Column, at: Column) -> Column:
    """A ring that begins at its vertex `at` (from 0)."""
    return F.concat(F.slice(points, at + 1, F.size(points)), F.slice(points, F.lit(1), at))


def _parts(rings: DataFrame) -> int:
    """How many tasks the vertices of rings are dealt to; tasks made of what a file or a shuffle holds compressed would grow with the table."""
    vertices = rings.agg(F.sum(F.size("points"))).first()[0] or 0
    return max(2 * rings.sparkSession.sparkContext.defaultParallelism, vertices // TASK_VERTICES + 1)


def ring_arcs(rings: DataFrame, parts: int | None = None) -> DataFrame:
    """code, poly, ring, k, arc: rings (code, poly, ring, points) cut at their junctions, in order; arcs have both ends.

    A junction is a vertex that has other neighbours in one ring than in another, or in one ring twice. A ring
    without one is a single arc from its lowest vertex back to it. parts is the number of tasks.
    """
    parts, ring, size = parts or _parts(rings), ["code", "poly", "ring"], F.size("points")
    rings = rings.repartition(parts, *ring)
    spot = F.explode(F.transform("points", lambda p, i: F.struct(p.alias("p"), F.get("points", (i - 1 + size) % size).alias("a"), F.get("points", (i + 1) % size).alias("b"))))
    seen = rings.select(spot.alias("v")).select("v.p", F.struct(F.least("v.a", "v.b").alias("a"), F.greatest("v.a", "v.b").alias("b")).alias("sides"))
    junctions = seen.repartition(parts, "p").groupBy("p").agg(F.min("sides").alias("x"), F.max("sides").alias("y")).where("x <> y").select("p", F.lit(True).alias("cut"))
    places = rings.select("code", "poly", "ring", F.posexplode("points").alias("i", "p")).repartition(parts, "p").join(junctions.hint("merge"), "p")
    cuts = places.repartition(parts, *ring).groupBy(*ring).agg(F.array_sort(F.collect_list("i")).alias("cuts"))
    rows = rings.join(cuts.hint("merge"), ring, "left")
    lowest = (F.array_position("points", F.array_min("points")) - 1).cast("int")
    rows = rows.withColumn("cuts", F.coalesce("cuts", F.array(lowest)))
    turned = _turned(F.col("points"), F.col("cuts")[0])
    rows = rows.withColumn("points", F.concat(turned, F.slice(turned, 1, 1)))
    first = F.col("cuts")[0]
    starts = F.transform("cuts", lambda c: c - first)
    spans = F.transform(starts, lambda s, k: F.slice("points", s + 1, F.coalesce(F.get(starts, k + 1), F.size("points") - 1) - s + 1))
    return rows.select("code", "poly", "ring", F.posexplode(spans).alias("k", "arc"))


def simplify_shared_borders(shapes: DataFrame, tolerance: float, least_area: float = 0.0) -> DataFrame:
    """code, poly, ring, points: outlines (code, poly, rings array<array<struct<x, y>>>, open, the outer ring first) thinned at the tolerance.

    Every arc between two junctions is thinned once, whichever way and in however many rings it runs. Rings left
    with fewer than three vertices go, a polygon with its outer one; so do polygons of less than least_area, but
    never the largest of a code. Polygons wholly east of the 180th meridian, that is with positive longitudes, are moved
    by -360 degrees where their code has others to the west of it.
    """
    rings = shapes.select("code", "poly", F.posexplode("rings").alias("ring", "points")).where(F.size("points") > 0)
    rings = cut(rings)  # no column is a constant then, which would be dealt in another way
    parts, ring = _parts(rings), ["code", "poly", "ring"]
    arcs = cut(ring_arcs(rings, parts))
    whole = F.least("arc", F.reverse("arc"))
    keyed = arcs.select("code", "poly", "ring", "k", whole.alias("key"), (F.col("arc") != whole).alias("back")).repartition(parts, "key")
    kind = keyed.schema["key"].dataType.simpleString()
    once = keyed.select("key").distinct().select("key", F.col("key").alias("points"))
    thin = once.mapInPandas(simplify_batches(tolerance), f"key {kind}, points {kind}").repartition(parts, "key")
    done = keyed.join(thin.hint("merge"), "key").select("code", "poly", "ring", "k", F.when(F.col("back"), F.reverse("points")).otherwise(F.col("points")).alias("points"))
    open_arc = F.slice("points", 1, F.size("points") - 1)
    whole_ring = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", open_arc.alias("points")))), lambda a: a["points"]))
    out = cut(done.repartition(parts, *ring).groupBy(*ring).agg(whole_ring.alias("points")).where(F.size("points") >= 3))
    outer = out.where("ring = 0").withColumn("area", ring_area(F.col("points"))).repartition(parts, "code")
    of_code = Window.partitionBy("code")
    ranked = outer.withColumn("top", F.row_number().over(of_code.orderBy(F.desc("area"), "poly")) == 1)
    east = F.array_min(F.transform("points", lambda p: p["x"])) > 0
    ranked = ranked.withColumn("east", east).withColumn("west", F.max(~east).over(of_code))
    kept = ranked.where(F.col("top") | (F.col("area") >= least_area)).select("code", "poly", (F.col("east") & F.col("west")).alias("moved"))
    moved = F.transform("points", lambda p: F.struct((p["x"] - 360).alias("x"), p["y"].alias("y")))
    return out.repartition(parts, "code", "poly").join(kept.repartition(parts, "code", "poly").hint("merge"), ["code", "poly"]).select("code", "poly", "ring", F.when(F.col("moved"), moved).otherwise(F.col("points")).alias("points"))

"""The trip report: states along a line, their miles and fuel, places, hours of driving and remarks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lines, series, spatial
from ..operators.durable import cut

#: Miles between samples of a straight line and of a route, and how far from either places are looked for.
STRAIGHT_STEP, ROUTE_STEP, STRAIGHT_BAND, ROUTE_BAND = 5.0, 1.0, 25.0, 5.0
#: A route so many times the straight line and so many miles more goes the long way; an end so far from the first node is told of.
LONG_TIMES, LONG_MILES, END_MILES = 1.6, 30.0, 25.0
#: Hours of driving that are marked, and what a truck does if nothing else is said: miles per gallon and an hour.
HOURS, MPG, MPH = (8, 11), 6.5, 55.0


class TripReport(NamedTuple):
    summary: DataFrame
    runs: DataFrame
    states: DataFrame
    hits: DataFrame
    marks: DataFrame


def path_samples(paths: DataFrame, step_mi: float) -> DataFrame:
    """trip_id, n, mile, lat, lon: points every step_mi miles of each leg of path (array<struct<lat, lon>>), and every vertex."""
    legs = paths.select("trip_id", F.posexplode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("p"), F.expr("slice(path, 2, size(path) - 1)").alias("q"))).alias("leg", "e"))
    legs = legs.select(F.struct("trip_id", "leg").alias("trip_id"), F.col("e.p.lat").alias("lat1"), F.col("e.p.lon").alias("lon1"), F.col("e.q.lat").alias("lat2"), F.col("e.q.lon").alias("lon2"))
    points = lines.sample_lines(legs, step_mi).where("n > 0 OR trip_id.leg = 0")
    order = Window.partitionBy("id").orderBy("leg", "k")
    rows = points.select(F.col("trip_id.trip_id").alias("id"), F.col("trip_id.leg").alias("leg"), F.col("n").alias("k"), "lat", "lon")
    rows = rows.withColumn("_p", F.lag(F.struct("lat", "lon")).over(order))
    far = F.coalesce(geo.miles("_p.lat", "_p.lon", "lat", "lon"), F.lit(0.0))
    return rows.select(F.col("id").alias("trip_id"), (F.row_number().over(order) - 1).cast("long").alias("n"), F.sum(far).over(order).alias("mile"), "lat", "lon")


def state_runs(samples: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (trip_id, run, code, from_mile, to_mile) of samples in one state, and trips with samples in none (trip_id)."""
    at = samples.select(F.struct("trip_id", "n").alias("id"), "lat", "lon")
    placed = cut(samples.join(spatial.locate(at, edges).select("id.trip_id", "id.n", "code"), ["trip_id", "n"], "left").select("trip_id", "n", "mile", "code"))
    runs = series.islands(placed, ["trip_id"], "n", "code")
    miles = placed.select("trip_id", "n", "mile")
    for n, name in (("begin", "from_mile"), ("end", "to_mile")):
        runs = runs.join(miles.select("trip_id", F.col("n").alias(n), F.col("mile").alias(name)), ["trip_id", n])
    return runs.select("trip_id", "run", "code", "from_mile", "to_mile"), placed.where("code IS NULL").select("trip_id").distinct()


def state_miles(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """trip_id, code, first, share, miles: the miles of each state; borders lie halfway between runs, whole miles add up to the trip's.

    first is the number of the run that the trip first enters the state in.
    """
    order = Window.partitionBy("trip_id").orderBy("run")
    rows = runs.join(totals, "trip_id")
    begin = F.coalesce((F.lag("to_mile").over(order) + F.col("from_mile")) / 2, F.lit(0.0))
    end = F.coalesce((F.col("to_mile") + F.lead("from_mile").over(order)) / 2, F.col("miles"))
    parts = rows.withColumn("own", end - begin).groupBy("trip_id", "code", F.col("miles").alias("whole")).agg(F.sum("own").alias("share"), F.min("run").alias("first"))
    found = series.largest_remainder(parts, ["trip_id"], "share", ["first"], F.floor(F.col("whole") + 0.5))
    return found.select("trip_id", "code", "first", "share", F.col("units").alias("miles"))


def run_of(places: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and run: the run of its trip that each mile lies in, or the nearest one, the first of two."""
    mile, begin, end = F.col("mile"), F.col("from_mile"), F.col("to_mile")
    gap = F.when(mile < begin, begin - mile).when(mile > end, mile - end).otherwise(0.0)
    met = places.join(runs.select("trip_id", "run", "from_mile", "to_mile"), "trip_id")
    return met.groupBy(*keys).agg(F.min(F.struct(gap.alias("gap"), "run"))["run"].alias("run"))


def trip_report(samples: DataFrame, ends: DataFrame, edges: DataFrame, points: DataFrame, prices: DataFrame, within_mi: float, mpg: float = MPG, mph: float = MPH, routed: bool = False) -> TripReport:
    """All tables of a batch of trips.

    samples: trip_id, n, mile, lat, lon. ends: trip_id, direct (miles of the straight line), end_a and end_b (miles from
    the typed ends to the first node; 0 on a straight line). points: id, kind, name, lat, lon; those of kind s (stops) and w
    count. prices: code, price (null: none). Hours are marked on routes only. Trips that cross no state have no states
    and no hits.
    """
    # A trip's places, states and marks are found by joins; nothing of one trip has to fit a task but its runs.
    totals = cut(samples.groupBy("trip_id").agg(F.max("mile").alias("miles")))
    runs, outside = state_runs(samples, edges)
    runs = cut(runs)
    near = lines.near_samples(points.where(F.col("kind").isin("s", "w")).select("id", "lat", "lon"), samples, within_mi)
    near = cut(near.select("trip_id", "id", "mile"))
    hits = near.join(run_of(near, runs, ["trip_id", "id"]).hint("merge"), ["trip_id", "id"])
    hits = cut(hits.join(points.select("id", "kind", "name").hint("merge"), "id").select("trip_id", "run", "mile", "id", "kind", "name"))

    states = state_miles(runs, totals).join(prices, "code", "left")
    gallons = F.col("miles") / mpg
    states = cut(states.select("trip_id", "code", "first", "miles", gallons.alias("gallons"), "price", (gallons * F.col("price")).alias("dollars")))

    marked = totals.select("trip_id", "miles", F.explode(F.array(*(F.lit(h) for h in HOURS))).alias("hours")).withColumn("mile", F.col("hours") * F.lit(mph))
    marked = marked.where((F.col("mile") < F.col("miles")) & F.lit(routed))
    stops = hits.where("kind = 's'").select("trip_id", F.col("mile").alias("at"), F.col("id").alias("stop"))
    before = marked.select("trip_id", "hours", "mile").join(stops, "trip_id").where("at <= mile").groupBy("trip_id", "hours").agg(F.max(F.struct("at", "stop")).alias("s"))
    marks = marked.select("trip_id", "hours", "mile").join(run_of(marked, runs, ["trip_id", "hours"]), ["trip_id", "hours"], "left").join(before, ["trip_id", "hours"], "left")
    marks = marks.select("trip_id", "hours", "mile", "run", F.col("s.stop").alias("stop"), F.col("s.at").alias("stop_mile"))

    money = states.groupBy("trip_id").agg(
        F.sum("gallons").alias("gallons"), F.sum("dollars").alias("dollars"), F.sum(F.when(F.col("price").isNull(), F.col("miles")).otherwise(0)).alias("unpriced"),
        F.min("price").alias("low"), F.max("price").alias("high"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "code", "price"))), lambda s: F.struct(s["code"].alias("code"), s["price"].alias("price"))).alias("entered"),
    )
    lowest = F.when(F.col("low") < F.col("high"), F.transform(F.filter("entered", lambda s: s["price"] == F.col("low")), lambda s: s["code"]))
    counted = hits.groupBy("trip_id").agg(F.count("*").alias("hits"))
    out = totals.join(ends, "trip_id", "left").join(money, "trip_id", "left").join(counted, "trip_id", "left").join(outside.withColumn("outside", F.lit(True)), "trip_id", "left")
    long_way = F.lit(routed) & (F.col("direct") > 0) & (F.col("miles") > LONG_TIMES * F.col("direct") + LONG_MILES)
    summary = out.select(
        "trip_id", "miles", "direct", "gallons", "dollars", "unpriced", "entered", lowest.alias("lowest"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"),
        F.coalesce("outside", F.lit(False)).alias("outside"), F.coalesce(long_way, F.lit(False)).alias("long_way"), (F.col("miles") / F.lit(mph)).alias("hours"),
        *(F.when(F.col(f"end_{k}") > END_MILES, F.col(f"end_{k}")).alias(f"far_{k}") for k in "ab"),
    )
    return TripReport(summary, runs, states, hits, marks)

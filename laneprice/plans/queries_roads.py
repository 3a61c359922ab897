"""Queries for road lines, exports, dates, trips and map layers, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..functions import geo as geometry
from ..operators import clusters, exports, lines, outlines, roads, spatial
from . import layers, trips, views
from .queries import _H
from .queries_places import _MILES, _SAMPLES, cell_edges
from .registered import query


def lattice(spark, sf):
    """a, b: links of a lattice of 40 columns of the customers; one in ten is missing. x and y of both ends."""
    k = views._t(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("d"), F.lit("R").alias("way")), F.struct(F.lit(40).alias("d"), F.lit("C").alias("way"))))
    rows = k.where("7 * k % 10 <> 3").select("k", steps.alias("s")).where("s.way = 'C' OR k % 40 < 39").select(F.col("k").alias("a"), (F.col("k") + F.col("s.d")).alias("b"), "s.way")
    rows = rows.join(k.withColumnRenamed("k", "b"), "b", "left_semi")
    x = lambda c: -124 + F.col(c) % 40 * 0.05 + F.expr(f"({c} div 40) div 3700") * 3.0
    y = lambda c: -75 + F.expr(f"(({c} div 40) % 3700)") * 0.04
    return rows.select("a", "b", "way", x("a").alias("x1"), y("a").alias("y1"), x("b").alias("x2"), y("b").alias("y2"))


_LATTICE = """k AS (SELECT c_custkey AS k FROM customer), g AS (SELECT k AS a, k + d AS b, way FROM k, (VALUES (1, 'R'), (40, 'C')) s(d, way) WHERE 7 * k % 10 <> 3 AND (way = 'C' OR k % 40 < 39) AND k + d IN (SELECT k FROM k)),
l AS (SELECT *, -124 + a % 40 * 0.05::DOUBLE + (a // 40) // 3700 * 3.0::DOUBLE AS x1, -75 + ((a // 40) % 3700) * 0.04::DOUBLE AS y1, -124 + b % 40 * 0.05::DOUBLE + (b // 40) // 3700 * 3.0::DOUBLE AS x2, -75 + ((b // 40) % 3700) * 0.04::DOUBLE AS y2 FROM g)"""


def _segments(spark, sf):
    turned = F.when(F.col("a") % 3 == 0, F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    points = F.coalesce(turned, F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    sign = F.when(F.col("way") == "R", F.concat(F.lit("R"), F.expr("a div 40").cast("string"))).otherwise(F.concat(F.lit("C"), (F.col("a") % 40).cast("string")))
    return lattice(spark, sf).select((F.col("a") * 2 + (F.col("way") == "C").cast("int")).alias("id"), sign.alias("sign"), F.lit(1).cast("long").alias("code"), points.alias("points"))


@query(f", {_LATTICE}, w AS (SELECT *, CASE WHEN way = 'R' THEN 'R' || (a // 40)::VARCHAR ELSE 'C' || (a % 40)::VARCHAR END AS sign, CASE WHEN way = 'R' THEN a ELSE a // 40 END AS p FROM l), r AS (SELECT *, p - row_number() OVER (PARTITION BY sign ORDER BY p) AS run FROM w) SELECT sign, count(*) AS segments, round(min(least(x1, x2)), 4) AS west, round(max(greatest(y1, y2)), 4) AS north FROM r GROUP BY sign, run")
def geo05_chain_segments(spark, sf):
    made = roads.chain_segments(_segments(spark, sf))
    ends = [F.array_min(F.transform("points", lambda p: p["x"])), F.array_max(F.transform("points", lambda p: p["y"]))]
    return made.select("sign", "segments", F.round(ends[0], 4).alias("west"), F.round(ends[1], 4).alias("north"))


@query(f", {_LATTICE}, n AS (SELECT floor(y1 * 10000 + 0.5)::BIGINT * 10000000 + floor(x1 * 10000 + 0.5)::BIGINT AS p, floor(y2 * 10000 + 0.5)::BIGINT * 10000000 + floor(x2 * 10000 + 0.5)::BIGINT AS q, y1 AS lat1, x1 AS lon1, y2 AS lat2, x2 AS lon2 FROM l) SELECT least(p, q) AS a, greatest(p, q) AS b, round({_MILES}, 5) AS miles FROM n")
def geo10_lattice_graph(spark, sf):
    ends = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("y1").alias("lat"), F.col("x1").alias("lon")), F.struct(F.lit(1).alias("n"), F.col("y2").alias("lat"), F.col("x2").alias("lon"))))
    rows = lattice(spark, sf).select((F.col("a") * 2 + (F.col("way") == "C").cast("int")).alias("line"), ends.alias("e")).select("line", "e.*")
    return clusters.road_graph(clusters.with_nodes(rows)).select("a", "b", F.round("miles", 5).alias("miles"))


_PROBES = ", ".join(f"({y}, {x})" for y in (0, 1, -1) for x in (0, 1, -1))


@query(f""", s AS (SELECT trip_id AS id, CASE WHEN trip_id % 2 = 0 THEN (trip_id % 25)::INTEGER END AS state, v.k, v.lat, v.lon FROM (SELECT *, unnest([{{'k': 1, 'lat': lat1 - 8 * (trip_id % 3), 'lon': lon1 - 20}}, {{'k': 2, 'lat': lat2 - 8 * (trip_id % 3), 'lon': lon1 - 20.01::DOUBLE}}]) AS v FROM v_trip)),
i AS (SELECT DISTINCT id FROM s JOIN v_cell ON lat >= lat0 AND lat < lat0 + 4.8::DOUBLE AND lon >= lon0 AND lon < lon0 + 11.4::DOUBLE),
m AS (SELECT id, state, k, lat, lon FROM s UNION ALL SELECT id, state, 3, lat, lon FROM s WHERE k = 2),
p AS (SELECT DISTINCT id, k FROM m, (VALUES {_PROBES}) q(dy, dx) JOIN v_cell c ON c.code = m.state AND lat + dy * 400 / 110.57::DOUBLE >= lat0 AND lat + dy * 400 / 110.57::DOUBLE < lat0 + 4.8::DOUBLE
  AND lon + dx * 400 / (111.32::DOUBLE * greatest(cos(radians(lat)), 0.05)) >= lon0 AND lon + dx * 400 / (111.32::DOUBLE * greatest(cos(radians(lat)), 0.05)) < lon0 + 11.4::DOUBLE),
n AS (SELECT id FROM p GROUP BY id HAVING count(*) = 3) SELECT id FROM i UNION SELECT id FROM n""")
def geo09_segments_in_states(spark, sf):
    t = views.trips(spark, sf)
    at = lambda lat, lon: F.struct(lon.alias("x"), lat.alias("y"))
    down = 8 * (F.col("trip_id") % 3)
    points = F.array(at(F.col("lat1") - down, F.col("lon1") - 20), at(F.col("lat2") - down, F.col("lon1") - 20.01))
    rows = t.select(F.col("trip_id").alias("id"), F.when(F.col("trip_id") % 2 == 0, (F.col("trip_id") % 25).cast("int")).alias("state"), points.alias("points"))
    return roads.segments_in_states(rows, cell_edges(spark, sf), 400.0).select("id")


def _vertices(spark, sf):
    """Trips as straight roads of a few vertices."""
    from .queries_places import _samples

    rows = _samples(spark, sf).where("n % 8 = 0").select(F.col("trip_id").alias("line"), "n", "lat", "lon")
    return clusters.with_nodes(rows)


@query(None)
def geo11_road_joins(spark, sf):
    return roads.road_joins(_vertices(spark, sf), 1.0)


@query(None)
def srt05_label_points(spark, sf):
    rows = _vertices(spark, sf).select((F.col("line") % 20).alias("route"), (F.col("line") % 20 % 3).cast("int").alias("kind"), "line", "n", "lat", "lon")
    return roads.label_points(rows)


@query(""", c AS (SELECT c_custkey AS code, c_custkey % 40 AS x, c_custkey // 40 AS y FROM customer), d AS (SELECT *, 0.05::DOUBLE * ((x + y) % 2) + CASE WHEN (x * 7 + y) % 3 = 0 THEN 0.3::DOUBLE ELSE 0 END AS r, CASE WHEN x > 0 THEN 0.05::DOUBLE * ((x - 1 + y) % 2) + CASE WHEN ((x - 1) * 7 + y) % 3 = 0 THEN 0.3::DOUBLE ELSE 0 END ELSE 0 END AS l FROM c)
SELECT code, (4 + (r > 0.2)::INTEGER + (l > 0.2)::INTEGER)::INTEGER AS n, round(1 + (CASE WHEN r > 0.2 THEN r ELSE 0 END - CASE WHEN l > 0.2 THEN l ELSE 0 END) / 2, 6) AS area FROM d""")
def geo08_shared_borders(spark, sf):
    """A grid of squares, one for each customer, whose upright borders bend at a vertex halfway: a little, which goes, or a lot, which stays in both squares."""
    k = views._t(spark, sf, "customer").selectExpr("c_custkey AS code", "c_custkey % 40 AS x", "c_custkey div 40 AS y")
    bend = lambda x: 0.05 * ((x + F.col("y")) % 2) + F.when((x * 7 + F.col("y")) % 3 == 0, 0.3).otherwise(0.0)
    at = lambda x, y: F.struct((x * 1.0).alias("x"), (y * 1.0).alias("y"))
    x, y = F.col("x"), F.col("y")
    halfway = lambda x: at(x + 1 + bend(x), y + 0.5)
    ring = F.concat(F.array(at(x, y), at(x + 1, y), halfway(x), at(x + 1, y + 1), at(x, y + 1)), F.when(x > 0, F.array(halfway(x - 1))).otherwise(F.array().cast("array<struct<x:double,y:double>>")))
    thin = outlines.simplify_shared_borders(k.select("code", F.lit(0).alias("poly"), F.array(ring).alias("rings")), 0.2)
    return thin.select("code", F.size("points").alias("n"), F.round(outlines.ring_area(F.col("points")), 6).alias("area"))


@query(" , q AS (SELECT *, rint_lat - coalesce(lag(rint_lat) OVER o, 0) AS d_lat, rint_lon - coalesce(lag(rint_lon) OVER o, 0) AS d_lon, row_number() OVER o AS seq FROM (SELECT state, name, ord * 37 % 1000 AS population, lat + ord % 7 / 100.0::DOUBLE AS lat, lon - ord % 9 / 100.0::DOUBLE AS lon, round((lat + ord % 7 / 100.0::DOUBLE) * 100)::BIGINT AS rint_lat, round((lon - ord % 9 / 100.0::DOUBLE) * 100)::BIGINT AS rint_lon FROM v_town) WINDOW o AS (PARTITION BY state ORDER BY population DESC, name, lat, lon)) SELECT state, string_agg(name || ':' || d_lat || ':' || d_lon, ';' ORDER BY seq) AS columns FROM q GROUP BY state")
def snk05_export_columnar(spark, sf):
    k = F.col("ord")
    rows = views.towns(spark, sf).select("name", "state", (k * 37 % 1000).alias("population"), (F.col("lat") + k % 7 / 100).alias("lat"), (F.col("lon") - k % 9 / 100).alias("lon"))
    got = exports.place_columns(rows, 2)
    told = F.transform(F.arrays_zip("names", "d_lat", "d_lon"), lambda p: F.concat_ws(":", p["names"], p["d_lat"], p["d_lon"]))
    return got.select("state", F.array_join(told, ";").alias("columns"))


@query(" SELECT o_orderkey AS id, strftime(o_orderdate, '%b %-d') AS short, CASE WHEN year(o_orderdate) = 1998 THEN strftime(o_orderdate, '%b %-d') ELSE strftime(o_orderdate, '%b %-d, %Y') END AS whn, strftime(o_orderdate, '%A, %b %-d') AS weekday, strftime(o_orderdate, '%B %Y') AS month, CASE WHEN month(o_orderdate) = 1 THEN year(o_orderdate)::VARCHAR ELSE strftime(o_orderdate, '%b') END AS tick, strftime(o_orderdate, '%-m/%-d/%y') AS badge, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS \"real\" FROM orders")
def scl07_dates(spark, sf):
    d = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, d.cast("string")).when(F.col("o_orderkey") % 2 == 0, "1998-02-30").otherwise("98-2-3")
    columns = {"short": calendar.short_date(d), "whn": calendar.when(d, F.lit("1998-05-05").cast("date")), "weekday": calendar.weekday_date(d), "month": calendar.month_year(d), "tick": calendar.month_tick(d), "badge": calendar.badge_date(d), "real": calendar.real_date(text)}
    return views._t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), *(c.alias(k) for k, c in columns.items()))


@query(" SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE AS day, DATE '1970-01-01' + floor((epoch_ms(ts) - event_id * 3600000) / 86400000.0::DOUBLE)::INTEGER AS epoch FROM events")
def scl10_days(spark, sf):
    e = views._t(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", calendar.day_in_new_york(F.col("ts")).alias("day"), calendar.epoch_day(F.unix_millis("ts") - F.col("event_id") * 3_600_000).alias("epoch"))


@query(" SELECT page_id, CASE WHEN page_id % 3 > 0 THEN '2026.0' || (1 + page_id % 9) || '.11' END AS version, CASE WHEN page_id % 4 > 0 AND page_id % 28 < 27 THEN DATE '2026-02-01' + (page_id % 28)::INTEGER END AS compiled FROM pages")
def scl18_versions(spark, sf):
    k = F.col("page_id")
    told = F.when(k % 3 > 0, F.concat(F.lit("Freight Version 2026.0"), (1 + k % 9).cast("string"), F.lit(".11, all rights"))).otherwise("no version")
    day = F.when(k % 28 < 27, F.date_format(F.date_add(F.lit("2026-02-01").cast("date"), (k % 28).cast("int")), "MMMM d, yyyy")).otherwise("February 31, 2026")
    text = F.when(k % 4 > 0, F.concat(F.lit("&lt;p&gt;It was <b>compiled on"), F.lit("</b> "), day, F.lit("</p>"))).otherwise("compiled")
    text = F.regexp_replace(text, "compiled on</b> ", "x</b>compiled on ")
    version, compiled = calendar.release_version(told, text, "Freight")
    return views._t(spark, sf, "pages").select("page_id", version.alias("version"), compiled.alias("compiled"))


def _prices(spark, sf):
    """code, price: dollars of the cells' states; a few have none."""
    k = F.col("n_nationkey")
    return views._t(spark, sf, "nation").select(k.alias("code"), F.when(k % 6 != 2, 3 + k % 4 / 10).alias("price"))


def _stops(spark, sf):
    kind = F.element_at(F.array(F.lit("s"), F.lit("w"), F.lit("v")), (F.col("id") % 3 + 1).cast("int"))
    return views.points(spark, sf).select("id", kind.alias("kind"), "name", "lat", "lon")


def _once_reported(spark, sf):
    """The reports of the first trips of those with equal ends, and whom they stand for (see once_each)."""
    firsts, members = lines.once_each(views.trips(spark, sf), "trip_id")
    samples = lines.sample_lines(firsts, 10.0)
    ends = ("lat1", "lon1", "lat2", "lon2")
    direct = firsts.select("trip_id", geometry.miles(*ends).alias("direct"), F.lit(0.0).alias("end_a"), F.lit(0.0).alias("end_b"))
    made = trips.trip_report(samples, direct, cell_edges(spark, sf), _stops(spark, sf), _prices(spark, sf), 15.0)
    return made, members


def _report(spark, sf) -> trips.TripReport:
    """The reports of trips with equal ends are made once."""
    made, members = _once_reported(spark, sf)
    return trips.TripReport(*(lines.for_each(t, members, "trip_id") for t in made))


_RUNS = f"""{_SAMPLES}, pl AS (SELECT s.*, c.code FROM s LEFT JOIN v_cell c ON lat >= lat0 AND lat < lat0 + 4.8::DOUBLE AND lon >= lon0 AND lon < lon0 + 11.4::DOUBLE),
kr AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY trip_id ORDER BY n) = code THEN 0 ELSE 1 END AS new FROM pl WHERE code IS NOT NULL), rr AS (SELECT *, sum(new) OVER (PARTITION BY trip_id ORDER BY n) AS run FROM kr),
ru AS (SELECT trip_id, run, code, min(mile) AS a, max(mile) AS b FROM rr GROUP BY 1, 2, 3), tot AS (SELECT trip_id, max(mile) AS miles FROM s GROUP BY 1),
ow AS (SELECT ru.trip_id, run, code, miles, coalesce((b + lead(a) OVER o) / 2, miles) - coalesce((lag(b) OVER o + a) / 2, 0) AS own FROM ru JOIN tot USING (trip_id) WINDOW o AS (PARTITION BY ru.trip_id ORDER BY run)),
sh AS (SELECT trip_id, code, miles AS whole, sum(own) AS share, min(run) AS first FROM ow GROUP BY 1, 2, 3),
st AS (SELECT *, floor(share)::BIGINT + CASE WHEN row_number() OVER (PARTITION BY trip_id ORDER BY share - floor(share) DESC, first) <= floor(whole + 0.5) - sum(floor(share)) OVER (PARTITION BY trip_id) THEN 1 ELSE 0 END AS miles FROM sh),
pr AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 6 <> 2 THEN 3 + n_nationkey % 4 / 10.0::DOUBLE END AS price FROM nation)"""


@query(f", {_RUNS} SELECT trip_id, code, miles, round(miles / 6.5::DOUBLE, 4) AS gallons, round(miles / 6.5::DOUBLE * price, 3) AS dollars FROM st LEFT JOIN pr USING (code)")
def rpt08_state_miles(spark, sf):
    return _report(spark, sf).states.select("trip_id", "code", "miles", F.round("gallons", 4).alias("gallons"), F.round("dollars", 3).alias("dollars"))


@query(f""", {_RUNS}, dd AS (SELECT a.trip_id, b.id, a.mile, {_H} AS metres FROM s a JOIN v_point b ON b.id % 3 < 2 AND abs(a.lat - b.lat) < 0.3), hh AS (SELECT trip_id, id FROM dd WHERE metres <= 15 * 1609.344::DOUBLE GROUP BY 1, 2),
hc AS (SELECT trip_id, count(*) AS hits FROM hh WHERE trip_id IN (SELECT trip_id FROM ru) GROUP BY 1), mo AS (SELECT trip_id, sum(miles / 6.5::DOUBLE) AS gallons, sum(miles / 6.5::DOUBLE * price) AS dollars, sum(CASE WHEN price IS NULL THEN miles ELSE 0 END) AS unpriced, min(price) AS lo, max(price) AS hi FROM st LEFT JOIN pr USING (code) GROUP BY 1),
lw AS (SELECT trip_id, string_agg(code::VARCHAR, ',' ORDER BY first) AS codes FROM st JOIN pr USING (code) JOIN mo USING (trip_id) WHERE price = lo AND lo < hi GROUP BY 1)
SELECT tot.trip_id, round(tot.miles, 4) AS miles, round(gallons, 4) AS gallons, round(dollars, 3) AS dollars, unpriced::BIGINT AS unpriced, codes AS lowest, coalesce(hits, 0) AS hits, tot.trip_id IN (SELECT trip_id FROM pl WHERE code IS NULL) AS outside FROM tot LEFT JOIN mo USING (trip_id) LEFT JOIN lw USING (trip_id) LEFT JOIN hc USING (trip_id)""")
def rpt08_trip_report(spark, sf):
    got = _report(spark, sf).summary
    return got.select("trip_id", F.round("miles", 4).alias("miles"), F.round("gallons", 4).alias("gallons"), F.round("dollars", 3).alias("dollars"), "unpriced", F.array_join(F.transform("lowest", lambda c: c.cast("string")), ",").alias("lowest"), "hits", "outside")


@query(f", {_RUNS}, dd AS (SELECT a.trip_id, b.id, a.mile, {_H} AS metres FROM s a JOIN v_point b ON b.id % 3 < 2 AND abs(a.lat - b.lat) < 0.3), hh AS (SELECT trip_id, id, mile FROM dd WHERE metres <= 15 * 1609.344::DOUBLE QUALIFY row_number() OVER (PARTITION BY trip_id, id ORDER BY metres, mile DESC) = 1) SELECT hh.trip_id, id, round(mile, 4) AS mile, run::BIGINT AS run FROM hh JOIN ru USING (trip_id) QUALIFY row_number() OVER (PARTITION BY hh.trip_id, id ORDER BY CASE WHEN mile < a THEN a - mile WHEN mile > b THEN mile - b ELSE 0 END, run) = 1")
def rpt08_corridor_hits(spark, sf):
    made, members = _once_reported(spark, sf)
    hits = made.hits.select("trip_id", "id", F.round("mile", 4).alias("mile"), "run")
    return lines.for_each(hits, members, "trip_id", lines.tasks_for(hits, members, "trip_id"))


_NEAR = f"SELECT a.id FROM of a JOIN v_point b ON b.id % 2 = 1 AND abs(a.lat - b.lat) < 0.02 WHERE {_H} <= 500"


@query(f", of AS (SELECT id, brand, lat, lon FROM v_point WHERE id % 2 = 0), m AS ({_NEAR}), c AS (SELECT brand, count(*) AS official, count(*) FILTER (id IN (SELECT id FROM m)) AS matched FROM of GROUP BY 1), n AS (SELECT brand, count(*) AS ours FROM v_point WHERE id % 2 = 1 GROUP BY 1) SELECT 'chain' AS part, coalesce(c.brand, n.brand) AS key, official, CASE WHEN c.brand < 'Brand#3' THEN matched END AS matched, coalesce(ours, 0) AS ours, round(CASE WHEN c.brand < 'Brand#3' THEN matched ELSE coalesce(ours, 0) END / nullif(official, 0), 3) AS share FROM c FULL JOIN n USING (brand) UNION ALL SELECT 'all', NULL, sum(official)::BIGINT, sum(matched)::BIGINT, NULL, round(sum(matched) / sum(official), 3) FROM c WHERE brand < 'Brand#3'")
def rpt09_coverage_report(spark, sf):
    p = views.points(spark, sf).select("id", "lat", "lon", F.col("brand").alias("key"))
    official, ours = p.where("id % 2 = 0"), p.where("id % 2 = 1")
    listed = official.select("key").distinct().where("key < 'Brand#3'")
    return layers.coverage_report(official, ours, listed, 500.0)


@query(None)
def rpt10_map_points(spark, sf):
    return layers.map_points(*_layer_inputs(spark, sf)).select("id", "kind", "name", "state", "sources", "road")


def _layer_inputs(spark, sf):
    p = views.points(spark, sf)
    roads_of = views.trips(spark, sf).select(F.col("trip_id").alias("line"), "lat1", "lon1", "lat2", "lon2", F.concat(F.lit("I"), "trip_id").alias("sign"), F.lit(2).alias("code"))
    stations = p.where("id % 3 = 0").select("id", "name", F.col("brand").alias("key"), "lat", "lon", F.lit(None).cast("int").alias("state"))
    services = p.where("id % 9 = 1").select("id", "name", F.lit("v").alias("key"), "lat", "lon", F.lit(None).cast("int").alias("state"))
    way = F.when(F.col("id") % 4 == 0, "eastbound").when(F.col("id") % 4 == 1, "westbound")
    weigh = p.where("id % 3 = 2").select("id", F.when(F.col("id") % 5 > 0, F.col("name")).alias("name"), F.lit(None).cast("string").alias("route"), way.alias("direction"), "lat", "lon", F.when(F.col("id") % 7 == 0, 3).alias("state"), (F.col("id") % 4).cast("int").alias("rank"), F.substring(F.lit("onif"), (F.col("id") % 4 + 1).cast("int"), F.lit(1)).alias("source"))
    return stations, services, weigh, roads_of, cell_edges(spark, sf)


@query(""", o AS (SELECT id, o.name AS name, lat, lon FROM v_object) SELECT count(*) AS elements, count(*) FILTER (name = '') AS unnamed FROM o""")
def rpt11_object_funnel(spark, sf):
    o = views.objects(spark, sf)
    return o.agg(F.count("*").alias("elements"), F.count_if(F.try_element_at("tags", F.lit("name")).isNull()).alias("unnamed"))


@query(None)
def rpt11_weigh_layer(spark, sf):
    return layers.weigh_layer(_elements(spark, sf), ["BRAZIL", "CANADA"], cell_edges(spark, sf), _all_edges(spark, sf))[0]


@query(None)
def rpt11_stations_layer(spark, sf):
    return layers.stations_layer(_elements(spark, sf), cell_edges(spark, sf))[0]


def _all_edges(spark, sf):
    return cell_edges(spark, sf).select("x1", "y1", "x2", "y2")


def _elements(spark, sf):
    kind = F.element_at(F.array(F.lit("way"), F.lit("node"), F.lit("relation")), (F.col("id") % 3 + 1).cast("int"))
    return views.objects(spark, sf).select(F.lit(0).alias("precedence"), kind.alias("type"), "id", "lat", "lon", "tags")

"""Objects, names, signs, borders, limits of the globe and typed places on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from laneprice.functions import tags
from laneprice.operators import borders, lines, places, spatial
from laneprice.sources import elements


def metres(a, b):
    (y1, x1), (y2, x2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


def test_distances_all_over_the_globe(spark):
    rng, spots = random.Random(5), []
    for lat, lon in ((52.0, 179.9999), (52.0, -179.9999), (85.0, 10.0), (89.99, -60.0), (-89.999, 170.0), (0.0, 0.0), (75.0, -180.0), (75.0, 180.0)):
        spots += [(lat + rng.uniform(-0.002, 0.002) * (abs(lat) < 89), lon + rng.uniform(-0.02, 0.02)) for _ in range(12)]
    rows = [(i, *p) for i, p in enumerate(spots)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    for radius in (300.0, 5000.0, 2_000_000.0):
        got = sorted((r.id_a, r.id_b) for r in spatial.distance_join(df, df, radius).collect())
        assert got == sorted((a[0], b[0]) for a in rows for b in rows if metres(a[1:], b[1:]) <= radius)


def test_nearest_line_far_north_and_over_the_date_line(spark):
    rng = random.Random(2)
    points = [(i, 71 + rng.uniform(-0.4, 0.4), -150 + rng.uniform(-1.5, 1.5)) for i in range(200)] + [(900, 60.0, 179.95), (901, 60.0, -179.95)]
    roads = [(1, 71.0, -151.0, 71.0, -149.0), (2, 60.0, -179.9, 60.1, -179.5)]
    got = {r.id: (r.line, r.km) for r in lines.nearest_line(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(roads, "line int, lat1 double, lon1 double, lat2 double, lon2 double"), 30.0).collect()}
    k = math.cos(math.radians(1)) and 111.32
    for i, lat, lon in points[:200]:
        kx = k * math.cos(math.radians(lat))
        km = math.hypot((max(-151.0, min(-149.0, lon)) - lon) * kx, (71.0 - lat) * 110.574)
        assert (i in got) == (km <= 30.0) and (km > 30.0 or abs(got[i][1] - km) < 1e-6)
    assert got[900][0] == got[901][0] == 2


def test_salted_and_broadcast_polygons_agree(spark, monkeypatch):
    square = lambda c, p, h, x, y, n: [(c, p, h, x + a[0] * n, y + a[1] * n, x + b[0] * n, y + b[1] * n) for a, b in zip([(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 0), (1, 1), (0, 1), (0, 0)])]
    edges = square("A", 0, False, 0.0, 0.0, 10.0) + square("A", 0, True, 2.0, 2.0, 3.0) + square("B", 0, False, 20.0, 0.0, 5.0)
    edges = [(c, int(h), h, *e) for c, _, h, *e in edges]
    df = spark.createDataFrame(edges, "code string, ring int, is_hole boolean, x1 double, y1 double, x2 double, y2 double")
    at = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 2.0, 22.0), (4, 2.0, 15.0), (5, 10.005, 5.0)], "id int, lat double, lon double")
    for most in (200_000, 0):
        monkeypatch.setattr(spatial, "BROADCAST_EDGES", most)
        assert sorted(map(tuple, spatial.locate(at, df).collect())) == [(1, "A"), (3, "B")]
        assert sorted(map(tuple, spatial.locate_near(at, df, 1.0).collect())) == [(1, "A"), (3, "B"), (5, "A")]


def test_elements(spark):
    kept = [("way", 1, 1.0, 2.0, None, {"name": "x"}), ("node", 2, None, None, (3.0, 4.0), None), ("way", 3, None, None, None, {}), ("area", 4, 1.0, 1.0, None, {})]
    rows = [("a", None, ("2026-09-19T00:00:00Z",), kept), ("b", "Query timed out", ("2026-09-19T00:00:00Z",), kept[:1]), ("c", None, None, kept[:1]), ("d", None, ("2026-09-19T00:00:00Z",), [])]
    schema = "response string, " + elements.ELEMENTS.replace("tags:", "tags:")
    df = spark.createDataFrame([(r, m, o, e) for r, m, o, e in rows], schema)
    got = sorted((r.response, r.id, r.lat, r.lon, len(r.tags), r.reject) for r in elements.load_tagged_elements(df).collect())
    assert got == [("a", 1, 1.0, 2.0, 1, None), ("a", 2, 3.0, 4.0, 0, None), ("a", 4, 1.0, 1.0, 0, "unknown element"), ("b", 1, 1.0, 2.0, 1, "remark"), ("c", 1, 1.0, 2.0, 1, "no base time")]


def test_rules_on_tags(spark):
    cases = [
        ({"name": "Love's CAT Scale", "amenity": "weighbridge"}, "cat_scale"), ({"name": "New Mexico Port of Entry"}, "name"), ({"name": "Mexico gate"}, "border"), ({"name": "DMV"}, "vehicle_inspection"),
        ({"name": "DMV weigh station"}, "name"), ({"end_date": "2001", "name": "Weigh station"}, "closed"), ({"name": "Weigh station", "highway": "services"}, "name"), ({"name": "Weigh Station Rd."}, "road"),
        ({"amenity": "weighbridge", "name": "Truck stop"}, "private"), ({"amenity": "weighbridge"}, "private_scale"), ({"service": "weigh_station", "access": "no"}, "tag"), ({}, "weak"), ({"type": "route", "name": "Weigh station"}, "not_a_station"),
        ({"name": "Ohio Inspection Station"}, "name"), ({"name": "Inspection Station"}, "weak"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, tags map<string,string>")
    got = {r.id: r.why for r in df.select("id", tags.classify_element(["Ohio"]).alias("why")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_names_and_signs(spark):
    cases = [
        ("Osceola - Northbound", "I-29", None, "Osceola, I-29 northbound"), ("Weigh Station (Eastbound)", None, None, "Weigh station, eastbound"), (None, "I-35E", None, "Weigh station, I-35E"), ("I 75 scale", "I-75N", None, "I 75 scale, northbound"),
        ("Fremont", "I39/NB/SB", "SB", "Fremont, I39/NB/SB southbound"), ("Weight scale", "US 9W", None, "Weigh station, US 9W"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "id int, name string, route string, way string")
    got = {r.id: r.j for r in df.select("id", tags.join_weigh(tags.weigh_parts(F.col("name"), F.col("route"), F.col("way"))).alias("j")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_border_posts(spark):
    outline = spark.createDataFrame([(-100.0, 30.0, -90.0, 30.0)], "x1 double, y1 double, x2 double, y2 double")
    rows = [(1, 30.05, -95.0, "Port of Entry", False), (2, 30.05, -95.0, "Port of Entry", True), (3, 30.5, -95.0, "Port of Entry", False), (4, 30.05, -95.0, "POE scale", False), (5, 50.0, -95.0, "Crossing", None), (6, 30.0, -95.0, None, False)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double, name string, gov boolean")
    assert sorted(r.id for r in borders.away_from_border(df, outline).collect()) == [2, 3, 4, 5, 6]
    far = {r.id: r.km for r in borders.border_distance(df, outline).collect()}
    assert abs(far[1] - 0.05 * 110.57) < 1e-6 and far[5] == float("inf")


def test_typed_places(spark):
    towns = [(0, "New York City", "NY"), (1, "West New York", "NJ"), (2, "Dallas", "TX"), (3, "St. Charles", "MD"), (4, "Saint Charles", "MD"), (5, "Plant City", "FL"), (6, "Plantation", "FL"), (7, "Wyoming", "MI"), (8, "Salem", "OR"), (9, "Salem", "MA"), (10, "Charleston", "WV"), (11, "Rocky Mount", "NC")]
    states = [("NY", "New York"), ("TX", "Texas"), ("WY", "Wyoming"), ("VA", "Virginia"), ("WV", "West Virginia"), ("MD", "Maryland"), ("FL", "Florida"), ("MO", "Missouri"), ("MA", "Massachusetts"), ("NJ", "New Jersey")]
    asked = {"new york": ("place", 0), "West New York": ("place", 1), "dallas texas": ("place", 2), "dallas,tx": ("place", 2), "Dallas": ("place", 2), "st charles, md": ("place", 3), "Plant, FL": ("ask", 5), "plantat": ("place", 6), "Wyoming": ("ask", 7), "Missouri": ("none", None), "salem": ("ask", 8), "Salem Massachusetts": ("place", 9), "charleston west virginia": ("place", 10), "": ("none", None), "rocky mount": ("place", 11)}
    df = spark.createDataFrame(list(enumerate(asked)), "qid int, q string").union(spark.createDataFrame([(99, None)], "qid int, q string"))
    got = {r.qid: (r.outcome, r.ord) for r in places.resolve_places(df, spark.createDataFrame(towns, "ord int, name string, state string"), spark.createDataFrame(states, "code string, name string")).collect()}
    assert got == {**dict(enumerate(asked.values())), 99: ("none", None)}


def test_boundaries_of_kml_and_geojson(spark, tmp_path):
    ring = "1,2 3,2 3,4 1,2"
    (tmp_path / "a.kml").write_text(f"""<kml><Document><Placemark><ExtendedData><SchemaData><SimpleData name="STUSPS">OH</SimpleData></SchemaData></ExtendedData>
<Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark></Document></kml>""")
    (tmp_path / "b.json").write_text('{"features": [{"properties": {"STUSPS": "OH"}, "geometry": {"type": "Polygon", "coordinates": [[[1,2],[3,2],[3,4],[1,2]],[[1,2],[3,2],[3,4],[1,2]]]}}]}')
    for shapes in (elements.read_boundaries_kml(spark, str(tmp_path / "a.kml"), "STUSPS"), elements.read_boundaries(spark, str(tmp_path / "b.json"), "STUSPS")):
        edges, rejects = elements.boundary_edges(shapes)
        assert sorted((r.code, r.ring, r.is_hole, r.x1, r.y1) for r in edges.collect()) == [("OH", k, k > 0, x, y) for k in (0, 1) for x, y in ((1.0, 2.0), (3.0, 2.0), (3.0, 4.0))]
        assert rejects.collect() == []

"""Road chains, joins, labels, outlines, trips and layers against plain versions on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from laneprice.operators import clusters, exports, outlines, roads
from laneprice.plans import layers, trips

SEGMENT = "id long, sign string, code long, points array<struct<x:double,y:double>>"


def plain_chains(segments):
    """The rule read literally: sorted segments, each unused one grows at its tail, then at its head."""
    out = []
    for group in sorted({(s[1] or "", s[2]) for s in segments}):
        own = sorted((s for s in segments if (s[1] or "", s[2]) == group), key=lambda s: (s[3][0], s[3][-1], len(s[3]), s[3]))
        left = list(own)

        def take(at):
            for s in left:
                for path in (s[3], s[3][::-1]):
                    if path[0] == at:
                        left.remove(s)
                        return path
            return None

        while left:
            first = left.pop(0)
            line = list(first[3])
            while more := take(line[-1]):
                line = line + more[1:]
            while more := take(line[0]):
                line = more[::-1] + line[1:]
            out.append((group[0] or None, first[0], line))
    return sorted(out, key=str)


def test_chains_of_segments(spark):
    rng = random.Random(4)
    spots = [(float(x), float(y)) for x in range(5) for y in range(4)]
    segments = []
    for i in range(70):
        a, b = rng.sample(spots, 2)
        segments.append((i, rng.choice(["I80", None]), rng.choice([1, 2]), [a, (a[0] + 0.3, a[1] + rng.random()), b]))
    df = spark.createDataFrame([(i, s, c, [(x, y) for x, y in p]) for i, s, c, p in segments] + [(99, "I80", 1, [])], SEGMENT)
    got = sorted(((r.sign, r.id, [(p.x, p.y) for p in r.points]) for r in roads.chain_segments(df).collect()), key=str)
    assert got == plain_chains(segments)


def km(a, b):
    k = 111.32 * math.cos(math.radians((a[0] + b[0]) / 2))
    return math.hypot((b[1] - a[1]) * k, (b[0] - a[0]) * 110.57)


def plain_joins(lines):
    """The rule read literally, one join after the other; points are (lat, lon)."""
    points = sorted({p for line in lines for p in line})
    near, made = {p: set() for p in points}, {"crossing": set(), "end": set(), "bridge": set()}
    for line in lines:
        for a, b in zip(line, line[1:]):
            near[a].add(b), near[b].add(a)

    def link(a, b, kind):
        if a != b and b not in near[a]:
            made[kind].add((min(a, b), max(a, b)))
            near[a].add(b), near[b].add(a)

    side = lambda p, q, r: (q[1] - p[1]) * (r[0] - p[0]) - (q[0] - p[0]) * (r[1] - p[1])
    for i, one in enumerate(lines):
        for two in lines[i + 1 :]:
            for a, b in zip(one, one[1:]):
                for c, d in zip(two, two[1:]):
                    if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                        link(*min(((p, q) for p in (a, b) for q in (c, d)), key=lambda e: km(*e)), "crossing")
    for line in lines:
        for end in (line[0], line[-1]):
            reach = [(km(end, q), q) for q in points if q != end and q not in near[end] and km(end, q) <= roads.JOIN_KM]
            if reach:
                link(end, min(reach)[1], "end")
    while True:
        pieces, seen = [], set()
        for p in points:
            if p not in seen:
                piece, todo = set(), [p]
                while todo:
                    q = todo.pop()
                    if q not in piece:
                        piece.add(q)
                        todo += near[q]
                seen |= piece
                pieces.append(piece)
        big = max(pieces, key=len)
        for piece in sorted(pieces, key=lambda x: (len(x), min(x))):
            reach = [(km(a, b), a, b) for a in piece for b in points if b not in piece and km(a, b) < roads.BRIDGE_KM]
            if piece is not big and reach:
                link(*min(reach)[1:], "bridge")
                break
        else:
            return made


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_make_one_graph(spark, seed):
    rng, lines = random.Random(seed), []
    for _ in range(9):
        lat, lon = rng.uniform(40, 40.5), rng.uniform(-90, -89.4)
        lines.append([(round(lat + i * rng.uniform(-0.02, 0.05), 3), round(lon + i * rng.uniform(0.01, 0.06), 3)) for i in range(rng.randrange(2, 5))])
    rows = [(n, i, *p) for n, line in enumerate(lines) for i, p in enumerate(line)]
    df = clusters.with_nodes(spark.createDataFrame(rows, "line long, n long, lat double, lon double"))
    at = {r.node: (r.lat, r.lon) for r in df.collect()}
    got = {"crossing": set(), "end": set(), "bridge": set()}
    for r in roads.road_joins(df).collect():
        a, b = sorted((at[r.a], at[r.b]))
        got[r.kind].add((a, b))
    assert got == plain_joins(lines)


def test_labels(spark):
    line = [(40.0, -100.0 + i) for i in range(13)]  # 1022 km
    rows = [(1, 1, 0, i, *p) for i, p in enumerate(line)] + [(2, 2, 1, i, 41.0, -90.0 + i * 0.02) for i in range(4)] + [(3, 0, 2, i, 40.1, -100.0 + i * 2.0) for i in range(2)] + [(4, 0, 3, i, 30.0, -80.0 + i * 0.01) for i in range(2)]
    df = spark.createDataFrame(rows, "route int, kind int, line long, n long, lat double, lon double")
    got = sorted((r.route, r.k, round(r.lat, 3), round(r.lon, 3)) for r in roads.label_points(df).collect())
    per = 111.32 * math.cos(math.radians(40.0))
    want = [(1, k, 40.0, round(-100.0 + (200 + 400 * k) / per, 3)) for k in range(3)] + [(2, 0, 41.0, -89.96)]
    third = -100.0 + 100 / (111.32 * math.cos(math.radians(40.1)))
    want += [(3, 0, 40.1, round(third, 3))] if all(km((40.1, third), (w[2], w[3])) >= 40 for w in want) else []
    assert got == want


def test_shared_borders(spark):
    rng = random.Random(1)
    border = [(5.0 + rng.uniform(-0.05, 0.05), y / 10) for y in range(1, 100)]
    left = [(0.0, 0.0), (5.0, 0.0), *border, (5.0, 10.0), (0.0, 10.0)]
    right = [(5.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 10.0), *reversed(border)]
    speck = [(20.0, 20.0), (20.01, 20.0), (20.0, 20.01)]
    island = [(30 + math.cos(t / 10), 30 + math.sin(t / 10)) for t in range(63)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    shapes = [("A", 0, [left, hole]), ("B", 0, [right]), ("A", 1, [speck]), ("C", 0, [speck]), ("D", 0, [island]), ("E", 0, [[(-170.0, 1.0), (-169.0, 1.0), (-169.0, 2.0)]]), ("E", 1, [[(175.0, 1.0), (176.0, 1.0), (176.0, 2.0)]])]
    df = spark.createDataFrame(shapes, "code string, poly int, rings array<array<struct<x:double,y:double>>>")
    got = {(r.code, r.poly, r.ring): [(p.x, p.y) for p in r.points] for r in outlines.simplify_shared_borders(df, 0.2, 0.01).collect()}
    assert set(got) == {("A", 0, 0), ("A", 0, 1), ("B", 0, 0), ("D", 0, 0), ("E", 0, 0), ("E", 1, 0)}
    inner = lambda ring: sorted(p for p in ring if 4.9 < p[0] < 5.1)
    assert inner(got["A", 0, 0]) == inner(got["B", 0, 0]) and len(got["A", 0, 0]) < 10 and 4 < len(got["D", 0, 0]) < 20
    assert max(x for x, _ in got["E", 1, 0]) < -180 and sorted(got["A", 0, 1]) == sorted(hole)


def test_thinning_and_the_last_of_a_sign(spark):
    rows = [("I1", 1, [(0.0, 0.0), (0.1, 0.001), (1.0, 0.0)]), ("I2", 2, [(0.0, 0.0), (0.001, 0.0)]), ("I2", 3, [(5.0, 0.0), (5.003, 0.0)]), ("I1", 4, [(0.0, 0.0), (0.001, 0.0)]), (None, 5, [(1.0, 1.0), (1.0, 1.0)]), ("I3", 6, []), ("I3", 7, None)]
    df = spark.createDataFrame(rows, "sign string, line long, points array<struct<x:double,y:double>>")
    got = {r.line: (r.sign, [(p.x, p.y) for p in r.points]) for r in clusters.quantize_lines(df, 0.05, 1).collect()}
    assert got == {1: ("I1", [(0, 0), (10, 0)]), 3: ("I2", [(50, 0), (51, 0)]), 5: (None, [(10, 10), (11, 10)])}
    thin = {r.line: r.points for r in clusters.simplify_lines(df, 0.05).collect()}
    assert thin[6] == [] and thin[7] is None and len(thin[1]) == 2
    # A closed ring, and vertices nearer than half the tolerance to the one kept before them.
    ring = [(0.0, 0.0), (0.0, 3.0), (0.01, 3.0), (3.0, 3.0), (0.0, 0.0)]
    points = clusters._thin([{"x": x, "y": y} for x, y in ring], 0.5)
    assert [(p["x"], p["y"]) for p in points] == [(0.0, 0.0), (0.0, 3.0), (3.0, 3.0), (0.0, 0.0)]


def test_columns_read_back(spark):
    rows = [("b", "X", 30.115, -90.25, 5), ("a", "X", 31.0, -91.0, 5), ("c", "Y", 10.0, 10.0, None)]
    df = spark.createDataFrame(rows, "name string, state string, lat double, lon double, population int")
    back = exports.decode_place_columns(exports.place_columns(df, 2), 2)
    assert sorted((r.state, r.seq, r.name, r.lat, r.lon) for r in back.collect()) == [("X", 1, "a", 31.0, -91.0), ("X", 2, "b", 30.12, -90.25), ("Y", 1, "c", 10.0, 10.0)]
    shapes = spark.createDataFrame([("A", 0, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)]])], "code string, poly int, rings array<array<struct<x:double,y:double>>>")
    row = exports.polygon_columns(shapes, 1).first()
    assert [[(d.dx, d.dy) for d in ring] for ring in row.polygons[0]] == [[(0, 0), (10, 0), (0, 10), (-10, 0)]] and (row.west, row.north) == (0.0, 1.0)


def square(code, x, y, n):
    ring = [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    return [(code, 0, False, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]


def test_trip_report(spark):
    edges = spark.createDataFrame(square("A", 0.0, 0.0, 2.0) + square("B", 2.0, 0.0, 2.0) + square("C", 5.0, 0.0, 9.0), "code string, ring int, is_hole boolean, x1 double, y1 double, x2 double, y2 double")
    path = [(1.0, 0.5), (1.0, 3.0), (1.0, 7.0)]
    paths = spark.createDataFrame([(1, path)], "trip_id int, path array<struct<lat:double,lon:double>>")
    samples = trips.path_samples(paths, 1.0)
    miles = samples.agg(F.max("mile")).first()[0]
    assert abs(miles - 6.5 * 69.09 * math.cos(math.radians(1))) < 0.5
    ends = spark.createDataFrame([(1, 100.0, 30.0, 1.0)], "trip_id int, direct double, end_a double, end_b double")
    points = spark.createDataFrame([(1, "s", "x", 1.0, 1.0), (2, "w", "y", 1.01, 4.4), (3, "v", "z", 1.0, 1.5), (4, "s", "far", 3.0, 1.0), (5, "s", "u", 1.0, 6.0)], "id int, kind string, name string, lat double, lon double")
    prices = spark.createDataFrame([("A", 4.0), ("B", None), ("C", 3.0)], "code string, price double")
    got = trips.trip_report(samples, ends, edges, points, prices, 5.0, mpg=5.0, mph=30.0, routed=True)
    s = got.summary.first()
    states = {r.code: r.miles for r in got.states.collect()}
    assert sum(states.values()) == round(miles) and set(states) == {"A", "B", "C"} and abs(states["B"] - 2.5 * 69.08) < 2
    assert s.unpriced == states["B"] and abs(s.dollars - states["A"] / 5 * 4 - states["C"] / 5 * 3) < 1e-9
    assert s.lowest == ["C"] and s.outside and s.long_way and (s.far_a, s.far_b) == (30.0, None) and s.hits == 3
    assert [e.code for e in s.entered] == ["A", "B", "C"]
    assert sorted((r.id, r.run) for r in got.hits.collect()) == [(1, 1), (2, 2), (5, 3)]
    marks = {r.hours: (r.mile, r.stop) for r in got.marks.collect()}
    assert marks == {8: (240.0, 1), 11: (330.0, 1)}
    empty = trips.trip_report(samples.limit(0), ends, edges, points, prices, 5.0)
    assert all(df.collect() == [] for df in empty)


def test_layers(spark):
    edges = spark.createDataFrame(square("X", -100.0, 30.0, 10.0), "code string, ring int, is_hole boolean, x1 double, y1 double, x2 double, y2 double")
    outline = edges.select("x1", "y1", "x2", "y2")
    loves = {"brand:wikidata": "Q1872496"}
    rows = [
        (0, "way", 1, 35.0, -95.0, {**loves, "name": " "}), (0, "node", 1, 35.0005, -95.0, {**loves, "name": "Shop"}), (1, "node", 1, 35.0, -95.0, {}), (0, "node", 2, 36.0, -95.0, {"name": "AmBest"}), (0, "node", 3, 50.0, -95.0, loves),
        (0, "node", 4, 37.0, -96.0, {"name": "Weigh Station", "operator": "State Police"}), (0, "way", 5, 37.003, -96.0, {"amenity": "weighbridge", "name": "Weigh Station A"}), (0, "node", 6, 30.01, -96.0, {"name": "Port of Entry"}),
        (0, "node", 7, 29.995, -96.0, {"name": "Weigh Station coast"}), (0, "node", 8, 37.0, -97.0, {"name": "Grain elevator scale"}),
    ]
    df = spark.createDataFrame(rows, "precedence int, type string, id long, lat double, lon double, tags map<string,string>")
    sites, funnel = layers.stations_layer(df, edges)
    assert [(r.brand, r.lat, r.name, r.refs, r.state) for r in sites.collect()] == [("loves", 35.00025, "Shop", ["w1", "n1"], "X")]
    assert {r.reason: r.n for r in funnel.collect()} == {"kept": 3, "dropped brand": 1, "unbranded": 5, "sites": 2, "in a state": 1}
    weigh, funnel = layers.weigh_layer(df, ["Ohio"], edges, outline)
    assert sorted((r.lat, r.name, r.via, r.gov, r.refs) for r in weigh.collect()) == [(29.995, "Weigh Station coast", "name", False, ["n7"]), (37.003, "Weigh Station A", "tag", True, ["w5", "n4"])]
    pins = spark.createDataFrame([(1, "Weigh station EB", 35.0, -95.0), (2, "weigh station", 35.0, -95.0), (3, "Weigh scale EB", 35.0001, -95.0), (4, "", 35.0, -95.0), (5, "Speedco", 35.0, -95.0), (6, "Speedco", 35.0001, -95.0), (7, "Speedco", None, 1.0), (8, "Speedco", 60.0, 1.0)], "row int, name string, lat double, lon double")
    kept, drops = layers.fleet_layer(pins, edges)
    assert sorted((r.category, r.direction or "", r.rows, r.state) for r in kept.collect()) == [("speedco", "", [5, 6], "X"), ("weigh", "", [1, 2], "X"), ("weigh", "EB", [3], "X")]
    assert {r.row: r.reason for r in drops.collect()} == {4: "empty name", 7: "bad coordinates"}


def test_map_points(spark):
    edges = spark.createDataFrame(square("X", -100.0, 30.0, 10.0), "code string, ring int, is_hole boolean, x1 double, y1 double, x2 double, y2 double")
    kind = "id long, name string, key string, lat double, lon double, state string"
    weigh = spark.createDataFrame([(10, "Osceola - Northbound", None, None, 35.0, -95.0, None, 0, "n"), (11, None, "I-35", None, 35.001, -95.0, "OK", 1, "i"), (12, "Weigh station", None, "SB", 35.001, -95.0, None, 2, "o")], "id long, name string, route string, direction string, lat double, lon double, state string, rank int, source string")
    lines = spark.createDataFrame([(1, 34.0, -95.005, 36.0, -95.005, "I35", 1)], "line long, lat1 double, lon1 double, lat2 double, lon2 double, sign string, code int")
    got = layers.map_points(spark.createDataFrame([(1, "Stop", "ta", 31.0, -91.0, None)], kind), spark.createDataFrame([(2, "Lube", "lubezone", 80.0, 0.0, None)], kind), weigh, lines, edges).collect()
    assert [(r.id, r.kind, r.name, r.state, r.sources, r.road, r.n) for r in got] == [
        (10, "w", "Osceola, I-35 northbound", "OK", "ni", "I 35, interstate", 2), (1, "s", "Stop", "X", None, None, 1), (12, "w", "Weigh station, southbound", "X", "o", "I 35, interstate", 2), (2, "v", "Lube", None, None, None, 1),
    ]

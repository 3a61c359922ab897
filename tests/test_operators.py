import datetime as dt
import math
import random

from pyspark.sql import functions as F

from laneprice.operators import relations, series, spatial

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_as_of_join_keeps_null_values_and_tolerance(spark):
    left = spark.createDataFrame([("a", D(i)) for i in (0, 3, 9, 20)] + [("b", D(3))], "k string, d date")
    right = spark.createDataFrame([("a", D(1), 1.0), ("a", D(8), None), ("a", D(10), 3.0)], "k string, at date, v double")
    got = {(r.k, r.d): r.v for r in series.as_of_join(left, right, ["k"], "d", "at", ["v"]).collect()}
    assert got == {("a", D(0)): None, ("a", D(3)): 1.0, ("a", D(9)): None, ("a", D(20)): 3.0, ("b", D(3)): None}
    near = {(r.k, r.d): r.v for r in series.as_of_join(left, right, ["k"], "d", "at", ["v"], tolerance=6).collect()}
    assert near[("a", D(20))] is None and near[("a", D(3))] == 1.0


def test_moves_round_half_away_from_zero(spark):
    rows = spark.createDataFrame([("a", D(0), "1.0000"), ("a", D(7), "1.0005"), ("a", D(14), "1.0000"), ("a", D(21), "1.0000")], "k string, d date, p string")
    got = series.moves(rows, ["k"], "d", F.col("p").cast("decimal(7,4)"), 3).orderBy("d").collect()
    assert [(str(r.change), r.direction) for r in got] == [("None", None), ("0.001", "up"), ("-0.001", "down"), ("0.000", "flat")]
    assert str(got[1].change_pct) == "0.10"


def test_ranks_skip_after_ties(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", None), ("e", 9)], "code string, v int")
    got = {r.code: (r.from_top, r.from_bottom, r.n_ranked) for r in relations.competition_rank(rows, "v", F.col("code") != "e").collect()}
    assert got == {"a": (1, 2, 3), "b": (1, 2, 3), "c": (3, 1, 3), "d": (None, None, None), "e": (None, None, None)}


def test_holes_and_distance(spark):
    ring = lambda code, n, hole, xy: [(code, n, hole, *xy[i], *xy[(i + 1) % len(xy)]) for i in range(len(xy))]
    edges = ring(1, 0, False, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]) + ring(1, 1, True, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)])
    e = spark.createDataFrame(edges, "code int, ring int, is_hole boolean, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 5.0), (4, 3.0, 1.5)], "id int, lat double, lon double")
    assert sorted((r.id, r.code) for r in spatial.locate(p, e).collect()) == [(1, 1), (4, 1)]
    far = spark.createDataFrame([(1, 60.0, 10.0), (2, 60.0, 10.01), (3, 60.0, 10.03)], "id int, lat double, lon double")
    assert sorted((r.id_a, r.id_b) for r in spatial.distance_join(far, far, 600.0).where("id_a < id_b").collect()) == [(1, 2)]


def test_content_equal_counts_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k int, s string")
    assert relations.content_equal(a, a.orderBy("k", ascending=False)).first().equal
    assert relations.content_equal(a, a.withColumn("s", F.lit("z")), ignore=("s",)).first().equal
    assert not relations.content_equal(a, a.union(a.limit(1))).first().equal


def test_as_of_joins_over_stretches(spark):
    r = random.Random(6)
    right = [(k, D(n), r.choice([None, float(n)])) for k in ("a", None) for n in r.sample(range(400), 150)] + [("a", None, 9.0)]
    left = [(r.choice(["a", "b", None]), D(r.randrange(-5, 420)), i) for i in range(300)] + [("a", None, 300)]
    df = series.as_of_join(spark.createDataFrame(left, "k string, d date, i int"), spark.createDataFrame(right, "k string, at date, v double"), ["k"], "d", "at", ["v"])
    got = {x["i"]: x["v"] for x in df.collect()}
    for k, d, i in left:
        before = [(at, v) for own, at, v in right if own == k and at is not None and d is not None and at <= d]
        assert got[i] == (max(before, key=lambda x: x[0])[1] if before else None)
    assert len(got) == len(left) and not series.as_of_join(df.select("k", "d"), spark.createDataFrame([], "k string, at date, v double"), ["k"], "d", "at", ["v"]).where("v IS NOT NULL").count()


def test_cells_inside_polygons_meet_no_edge(spark):
    r = random.Random(3)
    star = [(7 * (1 + k % 2) * math.cos(k * math.pi / 9) - 3.0, 7 * (1 + k % 2) * math.sin(k * math.pi / 9) + 1.0) for k in range(18)]
    rings = {1: [star, [(-4.0, 0.0), (-2.0, 0.0), (-2.0, 2.0), (-4.0, 2.0)]], 2: [[(-3.0, -9.0), (12.0, -9.0), (12.0, 3.0), (-3.0, 3.0)]]}
    edges = [(c, n, n > 0, *ring[i], *ring[(i + 1) % len(ring)]) for c, own in rings.items() for n, ring in enumerate(own) for i in range(len(ring))]
    at = [(i, r.uniform(-16, 18), r.uniform(-20, 15)) for i in range(600)] + [(600 + i, float(i % 5 - 3), float(i // 5 - 4)) for i in range(40)]
    e = spark.createDataFrame(edges, "code int, ring int, is_hole boolean, x1 double, y1 double, x2 double, y2 double")

    def odd(lat, lon, ring):
        return sum((y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) % 2

    want = {i: min(c for c, own in rings.items() if odd(lat, lon, own[0]) and not any(odd(lat, lon, h) for h in own[1:])) for i, lat, lon in at if any(odd(lat, lon, own[0]) and not any(odd(lat, lon, h) for h in own[1:]) for own in rings.values())}
    points = spark.createDataFrame(at, "id int, lat double, lon double")
    for size in (1.0, 0.7, 50.0):
        assert {x["id"]: x["code"] for x in spatial.locate(points, e, size).collect()} == want
    cells = spatial.polygon_cells(e.withColumn("poly", F.lit(0)), 1.0).groupBy("inside").count().collect()
    assert {x["inside"]: x["count"] for x in cells}[True] > 250  # most of the area needs no edge

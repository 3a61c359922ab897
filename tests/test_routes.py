"""Ways by nested cells against plain searches of the same graph."""

import heapq
import math
import pathlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from laneprice.operators import clusters, routes

from .measured import most_rows


def _plain(near, a):
    dist, heap = {}, [(0.0, a)]
    while heap:
        d, k = heapq.heappop(heap)
        if k not in dist:
            dist[k] = d
            for to, m in near.get(k, []):
                heapq.heappush(heap, (d + m, to))
    return dist


def test_ways_come_from_nested_cells(spark, monkeypatch):
    monkeypatch.setattr(routes, "CELL_EDGES", 32)
    monkeypatch.setattr(routes, "TASK_ENDS", 50)
    r = random.Random(6)
    # 30 x 30 towns with gaps, two far edges across, and a strip of its own beside them.
    at = {(i, j): (40 + i * 0.1 + r.random() * 0.02, -90 + j * 0.1 + r.random() * 0.02) for i in range(30) for j in [*range(30), *range(40, 43)]}
    number = {p: n for n, p in enumerate(at)}
    spot = {n: at[p] for p, n in number.items()}
    links = [(p, q) for p in at for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in at and r.random() < 0.85] + [((0, 0), (29, 29)), ((3, 29), (20, 1))]
    edges = [(number[p], number[q], math.dist(at[p], at[q]) * 70 * (1 + r.random())) for p, q in links]
    edges += [(b, a, m + 1) for a, b, m in edges[:40]]  # the other way round, and longer
    near = {}
    for a, b, m in edges:
        near.setdefault(a, []).append((b, m))
        near.setdefault(b, []).append((a, m))
    pairs = [(r.randrange(len(at)), r.randrange(len(at))) for _ in range(120)] + [(5, 5), (number[0, 41], number[29, 42]), (10_000, 10_000)]
    spot[10_000] = (10.0, 10.0)  # without edges
    asked, graph = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(edges, "a long, b long, miles double")
    places = spark.createDataFrame([(n, *xy) for n, xy in spot.items()], "node long, lat double, lon double")
    got = []
    # A search pair by pair holds a row for each node that it has reached for a pair.
    assert most_rows(spark, lambda: got.extend(routes.nested_ways(asked, graph, places, paths=True).collect())) < 20_000
    found = {(x["a"], x["b"]): x for x in got}
    assert len(found) == len(got) and found[5, 5]["nodes"] == [spot[5]]
    node = {xy: n for n, xy in spot.items()}
    for a, b in set(pairs):
        want = _plain(near, a).get(b)
        assert ((a, b) in found) == (want is not None)
        if want is not None:
            way = [node[tuple(p)] for p in found[a, b]["nodes"]]
            assert found[a, b]["miles"] == pytest.approx(want) and way[0] == a and way[-1] == b
            assert sum(min(m for k, m in near[p] if k == q) for p, q in zip(way, way[1:])) == pytest.approx(want)
    assert len(found) < len(set(pairs))
    trips = asked.selectExpr("a * 100000 + b AS trip_id", "a", "b")
    told = {(x["a"], x["b"]): x["miles"] for x in clusters.shortest_ways(trips, graph, places=places).collect()}
    assert set(told) == set(pairs) and all(m == (found[k]["miles"] if k in found else None) for k, m in told.items())
    # Cells that would be too large are left to the search in rounds.
    monkeypatch.setattr(routes, "MOST_NODES", 20)
    assert routes.nested_ways(asked, graph, places) is None


def test_lines_run_through_gaps():
    """Four strips of 8, 5, 9 and 6 columns, 300 rows long, have no edge between them; a line between two rows cuts 28."""
    columns, at = [range(8), range(8, 13), range(13, 22), range(22, 28)], []
    for strip in columns:
        for x in strip:
            at += [(y, x, y, x + 1) for y in range(300) if x + 1 in strip] + [(y, x, y + 1, x) for y in range(299)]
    edges = np.array(at, dtype=float)
    axis, where = routes._planes(edges, 2)

    def crossed(e, k):
        low, high = np.minimum(e[:, axis[k]], e[:, axis[k] + 2]), np.maximum(e[:, axis[k]], e[:, axis[k] + 2])
        return int(((low <= where[k]) & (high > where[k])).sum())

    assert axis[0] == 1 and crossed(edges, 0) == 0
    assert max(crossed(edges[edges[:, 3] <= where[0]], 1), crossed(edges[edges[:, 1] > where[0]], 2)) <= 15


def test_small_cells_share_groups(spark, monkeypatch):
    """A band of 6 x 120 nodes: the ways of the smallest cells, dealt one by one or together, are those of a plain search."""
    monkeypatch.setattr(routes, "CELL_EDGES", 32)
    monkeypatch.setattr(routes, "BUNCHED_FROM", 16)
    r, edges, near = random.Random(3), [], {}
    for y in range(120):
        for x in range(6):
            edges += [(y * 6 + x, to, 1 + r.random()) for to, fits in ((y * 6 + x + 1, x < 5), ((y + 1) * 6 + x, y < 119)) if fits and r.random() < 0.9]
    for a, b, m in edges:
        near.setdefault(a, []).append((b, m))
        near.setdefault(b, []).append((a, m))
    pairs = [(r.randrange(720), r.randrange(720)) for _ in range(80)]
    places = spark.createDataFrame([(y * 6 + x, y * 0.1, x * 0.1) for y in range(120) for x in range(6)], "node long, lat double, lon double")
    asked, graph = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(edges, "a long, b long, miles double")
    found = {(x["a"], x["b"]): x["miles"] for x in routes.nested_ways(asked, graph, places).collect()}
    for a, b in set(pairs):
        assert found.get((a, b)) == (None if _plain(near, a).get(b) is None else pytest.approx(_plain(near, a)[b]))


def test_snapping_spreads_the_points_not_the_nodes(spark):
    nodes = spark.range(4000).selectExpr("id AS node", "40 + id div 80 * 0.01D AS lat", "-90 + id % 80 * 0.01D AS lon", "4000L AS size").localCheckpoint()
    points = spark.createDataFrame([(1, 40.1001, -89.9002)], "id long, lat double, lon double")
    got = []
    assert most_rows(spark, lambda: got.extend(clusters.snap(points, nodes).collect())) < 12_000
    assert [tuple(x) for x in got] == [(1, 810)]


def test_lengths_are_those_of_the_paths(spark, monkeypatch):
    """A band of 6 x 30 nodes: walked is the length of the nodes' path, in nested cells and in rounds."""
    monkeypatch.setattr(routes, "CELL_EDGES", 32)
    r, spot = random.Random(8), {}
    spot = {y * 6 + x: (40 + y * 0.05 + r.random() * 0.01, -90 + x * 0.05 + r.random() * 0.01) for y in range(30) for x in range(6)}
    links = [(k, to) for k in spot for to, fits in ((k + 1, k % 6 < 5), (k + 6, k + 6 in spot)) if fits and r.random() < 0.9]
    rows = [(line, n, *spot[k]) for line, link in enumerate(links) for n, k in enumerate(link)]
    trips = [(k, *(v + r.random() * 0.02 for end in r.sample(sorted(spot), 2) for v in spot[end])) for k in range(15)]
    trips += [(15, *spot[7], *spot[7]), (16, *spot[7], None, None)]
    asked = spark.createDataFrame(trips, "trip_id long, lat_a double, lon_a double, lat_b double, lon_b double")
    lines = spark.createDataFrame(rows, "line int, n int, lat double, lon double")
    paths = {x["trip_id"]: x for x in clusters.route_trips(asked, lines).collect()}

    def miles(p, q):
        h = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 3958.7613 * math.asin(math.sqrt(h))

    def told():
        got = {x["trip_id"]: x for x in clusters.route_trips(asked, lines, walked=True).collect()}
        assert set(got) == set(paths) and sum(x["walked"] is not None for x in got.values()) > 10
        for k, x in got.items():
            p = paths[k]["path"]
            assert (x["a"], x["b"]) == (paths[k]["a"], paths[k]["b"])
            assert x["walked"] == (None if p is None else pytest.approx(sum(miles(*q) for q in zip(p, p[1:])), rel=1e-12))

    told()
    monkeypatch.setattr(routes, "MOST_NODES", 20)
    told()


def test_edges_count_by_their_legs():
    """Of a way from 0 to 3 the hop through the cell below stays a row, the edges are one, with the legs of their places."""
    arcs = pd.DataFrame([(4, 0, 1, 2.0, 1, 1, -1, 1.5), (4, 1, 2, 5.0, 1, 1, 16, 0.0), (4, 2, 3, 1.0, 1, 1, -1, 0.75), (4, 0, 3, 9.0, 1, 1, -1, 9.0)], columns=["cell", "a", "b", "miles", "ha", "hb", "below", "leg"])
    asked = pd.DataFrame([(4, 0, 3, None, None, None)], columns=["cell", "p", "q", "inner", "nodes", "dist"])
    assert routes._legs(arcs, asked)[["i", "from", "to", "below", "leg"]].values.tolist() == [[-1, 0, 3, -1, 2.25], [1, 1, 2, 16, 0.0]]


def test_trips_keep_no_paths(spark, tmp_path, monkeypatch):
    """Trips over a lattice 300 rows long: their length is told, but no table holds lists of places, whose size is trips times nodes."""
    from laneprice.operators import durable
    from laneprice.plans.catalog import QUERIES

    spark.range(12_000).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(durable, "shared_dir", lambda _: f"{tmp_path}/kept")
    rows = [x for x in QUERIES["geo12_route_trips"](spark, str(tmp_path)).collect() if x["miles"] is not None]
    # Rows of towns are 2.76 miles apart, and a trip's ends about a mile from theirs.
    assert len(rows) > 50 and max(x["miles"] for x in rows) > 100 and all(0 < x["walked"] - x["miles"] < 5 for x in rows)
    tables = [pq.ParquetFile(f).schema_arrow for f in pathlib.Path(tmp_path, "kept").glob("cut-*/*.parquet")]
    assert len(tables) > 20 and not [f for t in tables for f in t if pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type)]

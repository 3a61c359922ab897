"""Tasks of shared borders are as many as their vertices need."""

from laneprice.operators import outlines


def test_rings_of_one_file_are_dealt_by_vertices(spark, monkeypatch):
    at = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(20 * y + x, 0, [at((x, y), (x + 1, y), (x + 1.1, y + 0.5), (x + 1, y + 1), (x, y + 1), *([(x + 0.1, y + 0.5)] if x else []))]) for y in range(20) for x in range(20)]
    shapes = spark.createDataFrame(rows, "code int, poly int, rings array<array<struct<x:double,y:double>>>").coalesce(1)
    plain = lambda df: sorted((r.code, r.ring, [(p.x, p.y) for p in r.points]) for r in df.collect())
    want = plain(outlines.simplify_shared_borders(shapes, 0.2))
    assert len(want) == 400 and all(len(p) == 4 for _, _, p in want)
    monkeypatch.setattr(outlines, "TASK_VERTICES", 100)
    rings = shapes.selectExpr("code", "poly", "posexplode(rings) AS (ring, points)")
    arcs = outlines.ring_arcs(rings)
    assert arcs.rdd.getNumPartitions() >= 23 and arcs.select("code", "k").distinct().count() == arcs.count()
    assert plain(outlines.simplify_shared_borders(shapes, 0.2)) == want

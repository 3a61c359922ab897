import math
import random

from pyspark.sql import functions as F

from laneprice.llm import top_k


def brute(rows, k):
    out = []
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q, v in ok.items():
        if q % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok.items() if i != q)[:k]
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    for name, size in (("QUERY_BLOCK", 7), ("CANDIDATE_BLOCK", 40), ("SLICE_BLOCKS", 2), ("SLICE_QUERIES", 9)):
        monkeypatch.setattr(top_k, name, size)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(150)] + [(i, [0.25] * 6) for i in range(150, 190)]
    rows += [(300, None), (301, [None, 1.0]), (302, [float("nan")]), (305, [float("inf")]), (310, []), (315, [1.0]), (None, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    for k in (1, 5):
        assert sorted(map(tuple, top_k.exact_top_k(df, F.col("vec_id") % 5 == 0, k=k).collect())) == brute(rows, k)


def test_large_few_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(5, [1e30, 1.0]), (6, [1e30, 2.0]), (7, [-1.0, 0.5]), (5, [1e30, 1.0])], schema)
    got = sorted(map(tuple, top_k.exact_top_k(df, F.col("vec_id") % 5 == 0).collect()))
    assert got == [(5, 1, 6, 2**63 - 1), (5, 2, 7, -(2**63))]
    assert top_k.exact_top_k(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).collect() == []


def test_repeated_ids_are_each_found(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [3.0, 0.0]), (6, [0.0, 2.0]), (6, [0.0, 2.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k.exact_top_k(df, F.col("vec_id") % 5 == 0, k=4, scale=1.0).collect()))
    assert got == [(5, 1, 6, 3), (5, 2, 6, 2), (5, 3, 7, 1), (5, 4, 7, 1)]


def test_lists_are_read_in_part(spark, monkeypatch):
    monkeypatch.setattr(top_k, "CANDIDATE_BLOCK", 100)
    rng = random.Random(4)
    heads = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in heads[i % 10]]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k.exact_top_k(df, F.col("vec_id") % 50 == 0, counted=True).collect()
    want = [r for r in brute([(i, v) for i, v in rows], 5) if r[0] % 50 == 0]
    assert sorted(tuple(r)[:4] for r in got) == want
    read = {r.query_id: r.entries_read for r in got}
    assert sum(read.values()) < len(read) * 2000 * 8 / 2  # less than half of what all lists hold


def test_search_stops_before_the_lists_end():
    rng = top_k.np.random.default_rng(3)
    items = rng.integers(-100, 100, (400, 3)).astype(float)
    items[:5] = 1000.0
    lists = top_k.Lists(top_k.np.arange(400), items)
    ((_, who, score, entries),) = lists.search(top_k.np.array([[3.0, 2.0, 1.0]]), top_k.np.array([-1]), top_k.np.array([5000.0]), 5)
    assert who.tolist() == [0, 1, 2, 3, 4] and set(score) == {6000.0} and entries == 3 * 25

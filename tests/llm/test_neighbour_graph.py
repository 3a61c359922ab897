import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laneprice.llm import neighbour_graph as graph

KIND = "vec_id long, embedding array<double>, rank string, score string, node string"


def brute(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in ok), default=0)
    ids, x = np.array([i for i, _ in ok]), np.array([[*v, *[0.0] * (width - len(v))] for _, v in ok])
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def search(spark, rows, k=20):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KIND)
    found = {}
    for r in graph.nearest_by_graph(df, F.col("vec_id") % 20 == 0, k=k).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return found


def recall(rows, found, k=20):
    want, hits, score = brute(rows, k), 0, {}
    assert set(found) == {q for q, w in want.items() if w}
    for q, w in want.items():
        got = found.get(q, [])
        assert [x[2] for x in got] == list(range(1, len(got) + 1)) and len(got) == len(w)
        assert [x[:2] for x in got] == sorted((x[:2] for x in got), key=lambda x: (-x[1], x[0]))
        score = dict(brute_scores(rows, q))
        assert all(s == pytest.approx(score[i], rel=1e-12, abs=1e-12) for i, s, _ in got)
        hits += sum(s >= w[-1][1] * (1 - 1e-12) for _, s, _ in got)
    return hits / max(1, sum(map(len, want.values())))


def brute_scores(rows, q):
    own = next(np.array(v) for i, v in rows if i == q)
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            n = min(len(v), len(own))
            yield i, float(np.dot(np.array(v[:n]), own[:n]))


def test_recall_without_groups(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 64)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24))
    rows = list(enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()))
    found = search(spark, rows)
    assert recall(rows, found) >= 0.9 and all(len(v) == 20 for v in found.values())


def test_copies_lengths_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(90)]
    rows += [(100 + i, [1.0, 2.0, 0.0]) for i in range(70)] + [(200, [1.0, 2.0])]
    rows += [(300, None), (320, []), (340, [0.0, 0.0]), (360, [None, 1.0]), (380, [float("nan")]), (400, [float("inf")]), (None, [1.0]), (20, rows[20][1])]
    unique = list({i: r for i, r in enumerate(rows) if i != len(rows) - 1}.values())
    assert recall(unique, search(spark, rows)) >= 0.97


def test_few_and_none(spark):
    assert search(spark, []) == {} and search(spark, [(20, [1.0])]) == {}
    assert search(spark, [(20, [1.0, 0.0]), (3, [0.5, 0.0]), (2, [0.5, 1.0])]) == {20: [(2, 0.5, 1), (3, 0.5, 2)]}


def test_groups_without_an_offer(spark):
    # In a round some groups bring nothing that betters a list.
    made = graph._meetings(iter([pa.RecordBatch.from_pydict({"m": [1, 1], "x": [2, 3], "fresh": [True, True], "q": [bytes([1, 0]), bytes([0, 1])], "scale": [1.0, 1.0], "least": pa.array([5.0, 5.0], pa.float32())})]))
    assert list(made) == []

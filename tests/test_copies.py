"""Many points at a few places and many trips on a few lines: results as in SQL, from work that grows with places and lines."""

import duckdb
import pytest

from laneprice.plans.catalog import ORACLES, QUERIES

from .measured import metrics, most_rows
from .test_queries import SF, TABLES, plain


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """1200 points at 4 places, 200 trips on 4 lines."""
    d = str(tmp_path_factory.mktemp("copies"))
    for t in TABLES:
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "part":
            rows = rows.limit(1).drop("p_partkey").crossJoin(spark.sql("SELECT i.id * 57200 + j.id * 11 AS p_partkey FROM range(300) i, range(4) j"))
        if t == "supplier":
            rows = rows.limit(1).drop("s_suppkey").crossJoin(spark.sql("SELECT i.id * 400 + j.id AS s_suppkey FROM range(50) i, range(4) j"))
        rows.coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return d


def same_as_sql(spark, d, name):
    """How many rows the query has, once they are those of its SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, d), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert a == sorted((tuple(plain(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=str)
    return len(a)


# Rows of the largest step: pairs of points or lines would be 90,000 for each place and 2500 for each pair of lines.
@pytest.mark.parametrize("name", ["geo07_components", "agg04_coverage", "geo15_near_line", "jon09_nearest_line", "rpt08_trip_report", "rpt08_state_miles"])
def test_copies_are_met_once(spark, copies, name):
    assert most_rows(spark, lambda: same_as_sql(spark, copies, name)) <= 5000


@pytest.mark.parametrize("name", ["jon08_distance_join", "geo14_corridor_hits", "rpt08_corridor_hits", "jon13_crossings"])
def test_no_step_has_more_rows_than_the_result(spark, copies, name):
    n = []
    assert most_rows(spark, lambda: n.append(same_as_sql(spark, copies, name))) <= max(2.1 * n[0], 5000)


# A join that had every row of the result would sort and shuffle what is written out behind it.
@pytest.mark.parametrize("name", ["geo14_corridor_hits", "rpt08_corridor_hits"])
def test_hits_are_written_out_behind_the_joins(spark, copies, name):
    n = []
    assert max(metrics(spark, lambda: n.append(same_as_sql(spark, copies, name)), "Join", "number of output rows")) * 5 < n[0]


def test_arrays_and_tasks_are_bounded(spark, copies, monkeypatch):
    from laneprice.operators import lines

    monkeypatch.setattr(lines, "GROUP", 16)
    monkeypatch.setattr(lines, "TASK_ROWS", 1000)
    n = same_as_sql(spark, copies, "geo14_corridor_hits")
    df = QUERIES["geo14_corridor_hits"](spark, copies)
    assert df.rdd.getNumPartitions() == -(-n // 1000)
    rows = spark.range(300).selectExpr("id % 2 AS k", "id")
    sizes = [len(x["ids"]) for x in lines.grouped(rows, ["k"], "id", "ids").collect()]
    assert sum(sizes) == 300 and max(sizes) < 40


@pytest.mark.parametrize("name", ["jon08_distance_join", "geo14_corridor_hits"])
def test_cells_of_points_are_not_broadcast(spark, copies, name):
    assert metrics(spark, lambda: QUERIES[name](spark, copies).count(), "BroadcastExchange", "data size") == []


def test_equal_segments_cross_once(spark):
    """Two ways of 60 lines each that cross: a, b by the smaller line."""
    from laneprice.operators import clusters, roads

    rows = [(2 * i + k, n, 40.0 + n * 0.3, -100.0 + (n if k else 1 - n) * 0.4 + 0.01 * k) for i in range(60) for k in (0, 1) for n in (0, 1)]
    vertices = clusters.with_nodes(spark.createDataFrame(rows, "line long, n int, lat double, lon double"))
    once = vertices.where("line < 2")
    plain_ = lambda df: sorted(map(tuple, df.collect()))
    got = []
    assert most_rows(spark, lambda: got.extend(plain_(roads._crossings(vertices, 1.0)))) <= 1000
    both = plain_(roads._crossings(once, 1.0)) + plain_(roads._crossings(once.withColumn("line", 1 - once["line"]), 1.0))
    assert got == sorted(set(both)) and got

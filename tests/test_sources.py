"""Readers and writers on small files and pages."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from laneprice.sources import documents, sinks


def test_state_price_pages(spark):
    row = lambda code, price: f'<tr><td><a href="/x?state={code}">x</a></td><td>$3.10</td><td>{price}</td><td>$9.99</td></tr>'
    day, head = "Price as of 1/5/26", "<thead><tr><th>State</th><th>Regular</th><th>Diesel</th><th>E85</th></tr></thead><tbody>"
    page = lambda rows, day=day, head=head: f"{day}<table id='sortable'>{head}{rows}</tbody></table>"
    pages = [(1, page(row("OH", "$3.456") + row("TX", "$3.2345"))), (2, page(row("OH", "$3.456") + row("OH", "$3.457"))), (3, page(row("OH", "$3.456"), "")), (4, page("")), (5, None)]
    pages += [(6, page(row("OH", "$3.456"), head=head.replace("Diesel", "Gas"))), (7, day + "<table>" + row("OH", "$3.456") + "</table>"), (8, page(row("OH", "$3.456") + row("TX", "n/a"))), (9, page(row("OH", "$3.456"), "Price as of 13/45/26"))]
    got = {(r["page_id"], r["code"], r["price"] and str(r["price"]), r["reject"]) for r in documents.extract_state_prices(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    told = {2: "state twice", 3: "no single date", 4: "no rows", 5: "no table", 6: "no such column", 7: "no table", 8: "bad row", 9: "no single date"}
    assert got == {(1, "OH", "3.4560", None), (1, "TX", "3.2345", None)} | {(p, None, None, r) for p, r in told.items()}


def test_feeds_that_are_not_whole(spark):
    monday = datetime.date(2026, 1, 5)
    names = spark.createDataFrame([("East", "R1"), ("West", "R2")], "region string, series string")
    week = lambda n, *prices: [(monday + datetime.timedelta(days=7 * n), r, p) for r, p in prices]

    def run(rows):
        return sorted(map(tuple, documents.regional_feed(spark.createDataFrame(rows, "period date, region string, price string"), names, 2, 2).collect()))

    good = week(1, ("East", "3.4565"), (" West ", "3.1"))
    assert run(good + week(0, ("East", "3"))) == [("R1", good[0][0], 3457), ("R2", good[0][0], 3100)]  # the older week isn't whole
    assert len(run(good + week(0, ("East", "3"), ("West", "4"), ("Moon", "5")))) == 2
    for bad in (good + week(1, ("Moon", "3")), week(1, ("East", "3"), ("West", "")), good + week(0, ("East", "3"), ("East", "3")), good + week(0, ("East", "x")), week(1 / 7, ("East", "3"), ("West", "3"))):
        with pytest.raises(Exception, match="Moon|whole|twice|number|Monday"):
            run(bad)


def test_arcs(spark):
    arcs = spark.createDataFrame([(0, [(0, 0), (2, 0)]), (1, [(4, 4), (-2, -4)])], "arc int, deltas array<struct<dx:long,dy:long>>")
    refs = spark.createDataFrame([(7, 0, 0, False), (7, 1, 1, True)], "ring int, n int, arc int, reversed boolean")
    points = documents.assemble_arcs(arcs, refs, 0.5).first()["points"]
    assert [(p["x"], p["y"]) for p in points] == [(0.0, 0.0), (1.0, 0.0), (2.0, 2.0)]


def test_point_list(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("﻿" + ",".join(documents.POINT_LIST) + "\n1,a,b,40.5,x,1,,,t\n", encoding="utf-8")
    row = documents.read_point_list(spark, str(path)).first()
    assert row["Latitude"] == 40.5 and row["Longitude"] is None and row["ID"] == "1"
    path.write_text("ID,Name\n1,a\n")
    with pytest.raises(ValueError):
        documents.read_point_list(spark, str(path))


def test_lines_and_pages(spark):
    df = spark.createDataFrame([(1, " I\t80 ", [[1, 2], [3]]), (2, " ", [[1, 2]])], "id long, sign string, paths array<array<int>>")
    assert {(r["id"], r["sign"], r["path"]) for r in documents.flatten_lines(df).collect()} == {(1, "I80", 0), (2, None, 0)}


def test_nothing_is_written_when_a_rule_breaks(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    rows = spark.range(5)
    with pytest.raises(ValueError):
        sinks.write_validated({a: (rows, {"low": F.col("id") < 9}), b: (rows, {"low": F.col("id") < 3})})
    assert not os.path.exists(a) and not os.path.exists(b)
    sinks.write_validated({a: (rows, {"low": F.col("id") < 9}), b: (rows, {"low": F.col("id") < 5})})
    assert spark.read.parquet(b).count() == 5


def test_rejects(spark, tmp_path):
    rows = spark.createDataFrame([(2, "r", "n", "a"), (1, "q", "m", "b")], "row int, reason string, name string, address string")
    sinks.write_rejects(rows, str(tmp_path / "r"))
    assert [r["row"] for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == ["1", "2"]


def test_a_broken_swap_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_if_changed(spark.range(3), path)
    os.rename(path, path + ".old-1")  # as a crash between the renames leaves it
    assert sinks.exists(spark, path) and spark.read.parquet(path).count() == 3
    os.rename(path, path + ".old-2")
    assert sinks.write_if_changed(spark.range(4), path) and spark.read.parquet(path).count() == 4
    with pytest.raises(OSError):
        sinks._swap(spark, {path: str(tmp_path / "missing")})
    assert spark.read.parquet(path).count() == 4 and sorted(os.listdir(tmp_path)) == ["t"]


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_batch_rewrites_its_own_buckets(spark, tmp_path):
    from laneprice.streaming import prices

    target, state, out = tmp_path / "target", tmp_path / "state", tmp_path / "out"

    def arrive(rows):
        spark.createDataFrame(rows, "code int, as_of date, units long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = prices.read_arrivals(spark, str(tmp_path / "in"), "code int, as_of date, units long")
        prices.upsert_stream(source, str(target), ["code"], "as_of", str(tmp_path / "c1"), buckets=8).awaitTermination()
        prices.move_stream(source, str(state), str(out), "code", "as_of", "units", str(tmp_path / "c2"), buckets=8).awaitTermination()
        return [files(p) for p in (target, state, out)]

    day = datetime.date(2026, 1, 1)
    first = arrive([(c, day, 30_000 + c) for c in range(60)])
    assert all(len({p.parent for p in f}) == 8 for f in first)
    second = arrive([(7, day + datetime.timedelta(days=2), 39_000)])
    for a, b in zip(first, second):  # one bucket of each table is new, the others' files are the very same
        kept = {p for p in a if b.get(p) == a[p]}
        assert len({p.parent for p in kept}) == 7 and {p.parent for p in b} == {p.parent for p in a}
    got = {r["code"]: r["units"] for r in spark.read.parquet(str(target)).collect()}
    assert got == {c: 39_000 if c == 7 else 30_000 + c for c in range(60)}
    assert [(r["gap"], r["change"]) for r in spark.read.parquet(str(out)).where("code = 7").collect()] == [(2, 39_000 - 30_007)]
    assert arrive([(7, day, 1), (8, day, 5)]) == second  # older, or equal versions: nothing is written
    assert len(list(target.glob("_batch-*"))) == 3


def test_fingerprints_save_reading_the_old_table(spark, tmp_path):
    path = tmp_path / "t"
    df = spark.range(50).withColumn("s", F.col("id").cast("string"))
    assert sinks.write_if_changed(df, str(path)) and not sinks.write_if_changed(df.orderBy(F.desc("id")), str(path))
    assert not sinks.write_if_changed(df.withColumn("s", F.lit("other")), str(path), ignore=("s",))
    for p in path.glob("*.parquet"):
        p.write_bytes(b"not parquet")
    for p in path.glob(".*.crc"):
        p.unlink()
    assert sinks.write_if_changed(df.where("id < 49"), str(path))  # replaced without being read
    assert spark.read.parquet(str(path)).count() == 49 and not list(tmp_path.glob("t.new-*"))
    next(path.glob("_fingerprint-*")).unlink()
    assert not sinks.write_if_changed(df.where("id < 49"), str(path))  # without one the rows themselves are compared

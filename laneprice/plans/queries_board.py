"""Queries for joins, snapshots, checks and reports, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards, relations, series
from . import reports, views
from .registered import query

_TWO = "d AS (SELECT DISTINCT as_of FROM v_daily ORDER BY 1 DESC LIMIT 2), e AS (SELECT max(as_of) AS c, CASE WHEN count(*) = 2 THEN min(as_of) END AS p FROM d)"
_PAIR = f"{_TWO}, pair AS (SELECT code, max(units) FILTER (as_of = c) AS cur, max(units) FILTER (as_of = p) AS prev FROM v_daily, e WHERE as_of IN (c, p) GROUP BY 1)"
_LAST = "lw AS (SELECT series, max(period) AS period FROM v_weekly GROUP BY 1), lp AS (SELECT series, period, mills FROM v_weekly JOIN lw USING (series, period))"
_FLAGS = "concat_ws(',', CASE WHEN c - p > 1 THEN 'gap' END, CASE WHEN abs(cur - prev) >= 100 THEN 'large_move' END, CASE WHEN abs(cur - 10 * mills) > 200 THEN 'eia_divergence' END, CASE WHEN series IS NULL THEN 'no_eia_survey' END, CASE WHEN cur IS NOT NULL AND prev IS NULL THEN 'prev_missing' END)"


@query(" , r AS (SELECT *, lag(mills) OVER (PARTITION BY series ORDER BY period) AS prev, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS k FROM v_weekly) SELECT series, period, mills, prev, mills - prev AS change, round((mills - prev)::DOUBLE / prev * 100, 6) AS pct FROM r WHERE k = 1")
def win02_weekly_move(spark, sf):
    return series.weekly_move(views.weekly(spark, sf), ["series"], "period", "mills").withColumn("pct", F.round("pct", 6))


@query(", b AS (SELECT DATE '1996-03-05' AS x, DATE '1996-09-04' AS y), i AS (SELECT series, period, mills FROM v_weekly, b WHERE period BETWEEN x AND y), o AS (SELECT series, max(period) AS period, arg_max(mills, period) AS mills FROM v_weekly, b WHERE mills IS NOT NULL AND period < x GROUP BY 1), g AS (SELECT DISTINCT series, unnest([x, y]) AS period, NULL::BIGINT AS mills FROM v_weekly, b), r AS (SELECT * FROM i UNION ALL SELECT * FROM o UNION ALL SELECT * FROM g WHERE (series, period) NOT IN (SELECT (series, period) FROM i)), bench AS (SELECT 'R' || ((right(series, 1)::INTEGER + 1) % 5) AS series, period + 1 AS period, mills AS bench FROM v_weekly) SELECT r.series, r.period, r.mills, k.bench FROM r ASOF LEFT JOIN bench k ON k.series = r.series AND r.period >= k.period")
def win11_benchmark(spark, sf):
    w = views.weekly(spark, sf)
    bench = w.select(F.concat(F.lit("R"), (F.substring("series", 2, 1).cast("int") + 1) % 5).alias("series"), F.date_add("period", 1).alias("period"), F.col("mills").alias("bench"))
    day = lambda s: F.lit(s).cast("date")
    return series.benchmark_on_primary(w, bench, ["series"], "period", "mills", "bench", day("1996-03-05"), day("1996-09-04"))


@query(" SELECT l_orderkey, l_linenumber, sum(round(l_extendedprice * 100)::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, round(l_extendedprice * 100)::BIGINT ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM lineitem")
def win17_cumulative(spark, sf):
    rows = views._t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return series.cumulative(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "cents"], F.col("cents")).drop("cents", "l_partkey")


@query(f", {_PAIR} SELECT code, name, cur, prev, c - p AS gap FROM v_state LEFT JOIN pair USING (code), e")
def jon02_join_daily(spark, sf):
    return relations.join_snapshots(views.states(spark, sf).select("code", "name"), views.daily(spark, sf), "code", "as_of", "units")


@query(", p AS (SELECT code, arg_max(units, as_of) AS units FROM v_daily GROUP BY 1), q AS (SELECT code, mate FROM v_near UNION SELECT code, code FROM v_state), r AS (SELECT q.code, q.mate, b.units AS mate_price, b.units - a.units AS diff, CASE WHEN sb.region IS DISTINCT FROM sa.region THEN sb.region END AS mate_region, sb.name FROM q JOIN p b ON b.code = q.mate JOIN v_state sb ON sb.code = q.mate JOIN v_state sa ON sa.code = q.code LEFT JOIN p a ON a.code = q.code) SELECT code, row_number() OVER (PARTITION BY code ORDER BY mate_price, (code <> mate)::INTEGER, name) AS place, mate, mate_price, diff, mate_region FROM r")
def jon04_next_door(spark, sf):
    prices = views.daily(spark, sf).groupBy("code").agg(F.max_by("units", "as_of").alias("units"))
    return relations.next_door(views.states(spark, sf), views.neighbours(spark, sf), prices, "code", "units")


@query(" SELECT code, name, CASE WHEN NOT out_of_date THEN mils END AS mils FROM v_state LEFT JOIN v_tax USING (code)")
def jon05_join_tax(spark, sf):
    return boards.join_current(views.states(spark, sf).select("code", "name"), views.taxes(spark, sf), "code", "mils", "out_of_date")


@query(" SELECT code, count(*) AS checkable, count(*) FILTER (hint <> code) AS mismatches FROM (SELECT (c_custkey % 25)::INTEGER AS code, c_nationkey AS hint FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def jon14_hint_check(spark, sf):
    c = views._t(spark, sf, "customer").where("c_acctbal > 0").select((F.col("c_custkey") % 25).cast("int").alias("code"), F.array("c_nationkey").alias("hints"))
    return boards.hint_check(c, ["code"], "hints", "code")


@query(" SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jon15_membership(spark, sf):
    c = views._t(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    orders = views._t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.join(c.where("c_acctbal > 0"), "o_custkey", "left_semi").join(c.where("c_mktsegment = 'BUILDING'"), "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query(" SELECT s_suppkey, s_name, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def jon16_attach_dimension(spark, sf):
    nations = views._t(spark, sf, "nation").selectExpr("n_nationkey AS s_nationkey", "n_name", "n_regionkey")
    return relations.attach_dimension(views._t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), nations, "s_nationkey")


@query(", n AS (SELECT series, period, mills + 1 AS mills FROM v_weekly WHERE period BETWEEN DATE '2001-01-01' AND DATE '2001-06-04'), f AS (SELECT series, period, mills + 2 AS mills FROM v_weekly WHERE period BETWEEN DATE '2001-05-07' AND DATE '2001-07-02'), late AS (SELECT * FROM f WHERE period > (SELECT max(period) FROM n)), u AS (SELECT *, 'primary' AS source FROM n UNION ALL SELECT *, 'fallback' FROM late) SELECT * FROM u UNION ALL SELECT series, period, mills, 'existing' FROM v_weekly WHERE period NOT IN (SELECT period FROM u)")
def mrg02_provenance(spark, sf):
    w = views.weekly(spark, sf)
    a = w.where("period BETWEEN DATE '2001-01-01' AND DATE '2001-06-04'").withColumn("mills", F.col("mills") + 1)
    b = w.where("period BETWEEN DATE '2001-05-07' AND DATE '2001-07-02'").withColumn("mills", F.col("mills") + 2)
    return relations.merge_with_provenance(w, a, b, "period")


@query(" SELECT 'point' AS layer, id, name, brand, NULL AS direction FROM v_point WHERE id % 2 = 0 UNION ALL SELECT 'pin', id, name, NULL, 'n' FROM v_pin WHERE id % 2 = 1")
def mrg06_union_layers(spark, sf):
    a = views.points(spark, sf).where("id % 2 = 0").select(F.lit("point").alias("layer"), "id", "name", "brand")
    b = views.pins(spark, sf).where("id % 2 = 1").select(F.lit("pin").alias("layer"), "id", "name", F.lit("n").alias("direction"))
    return a.unionByName(b, allowMissingColumns=True)


@query(" SELECT region, string_agg(code, ',' ORDER BY code) AS members, count(*) FILTER (code <> 8) AS n, bool_or(code = 8) AS has_capital FROM v_state GROUP BY 1")
def agg07_region_members(spark, sf):
    s = views.states(spark, sf)
    return s.groupBy("region").agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("members"), F.count_if(F.col("code") != 8).alias("n"), F.bool_or(F.col("code") == 8).alias("has_capital"))


@query(" SELECT brand, count(DISTINCT name) AS names, count(DISTINCT floor(lat)) AS rows FROM v_point GROUP BY 1")
def agg02_count_distinct(spark, sf):
    return views.points(spark, sf).groupBy("brand").agg(F.count_distinct("name").alias("names"), F.count_distinct(F.floor("lat")).alias("rows"))


@query(" SELECT max(o_orderdate)::DATE AS newest FROM orders WHERE o_orderstatus = 'O'")
def agg10_newest(spark, sf):
    return views._t(spark, sf, "orders").where("o_orderstatus = 'O'").agg(F.to_date(F.max("o_orderdate")).alias("newest"))


@query(", t AS (SELECT *, max(period) OVER (PARTITION BY series) AS m FROM v_weekly WHERE mills IS NOT NULL), k AS (SELECT series, max(mills) FILTER (period = m) > max(mills) FILTER (period < m) AS rec FROM t GROUP BY 1) SELECT count(*) FILTER (rec) AS records, count(*) AS n, CASE count(*) FILTER (rec) WHEN 0 THEN 'none' WHEN count(*) THEN 'all' ELSE 'some' END AS word FROM k")
def agg11_peak_summary(spark, sf):
    kinds = series.peak_kind(views.weekly(spark, sf), ["series"], "period", "mills")
    found = kinds.agg(F.count_if(F.col("kind") == "record").alias("records"), F.count("*").alias("n"))
    return found.withColumn("word", F.when(F.col("records") == 0, "none").when(F.col("records") == F.col("n"), "all").otherwise("some"))


@query(", s AS (SELECT l_returnflag, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS size, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), t AS (SELECT l_returnflag, count(*) AS total FROM lineitem GROUP BY 1) SELECT l_returnflag, size, n, total, round(size::DOUBLE * total / n, 3) AS estimate FROM s JOIN t USING (l_returnflag)")
def agg12_size_estimate(spark, sf):
    rows = views._t(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    first = F.col("l_linenumber") == 1
    found = rows.groupBy("l_returnflag").agg(F.sum(F.when(first, F.col("cents"))).alias("size"), F.count_if(first).alias("n"), F.count("*").alias("total")).where("n > 0")
    return found.withColumn("estimate", F.round(F.col("size").cast("double") * F.col("total") / F.col("n"), 3))


@query(" SELECT (o_custkey % 25)::INTEGER AS code, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'P') AS p, count(*) > 0 AS any FROM orders GROUP BY 1")
def agg13_kinds_present(spark, sf):
    o = views._t(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 25).cast("int").alias("code")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"), (F.count("*") > 0).alias("any"))


@query(" SELECT code, mils, row_number() OVER (ORDER BY mils DESC NULLS LAST, code) AS place FROM v_tax")
def srt01_sort_quotes(spark, sf):
    return relations.numbered(views.taxes(spark, sf).select("code", "mils"), [F.desc_nulls_last("mils"), F.asc("code")])


@query(", o AS (SELECT id, brand, name, lat, lon, row_number() OVER (ORDER BY CASE WHEN id % 9 = 0 THEN '~' ELSE brand END, name, lat, lon, id) AS place FROM v_point) SELECT id, place FROM o")
def srt04_order_points(spark, sf):
    p = views.points(spark, sf).withColumn("s", F.when(F.col("id") % 9 == 0, "~").otherwise(F.col("brand")))
    return relations.numbered(p, [F.col(c) for c in ("s", "name", "lat", "lon", "id")]).select("id", "place")


@query(f", {_PAIR}, {_LAST} SELECT code, name, series, cur, prev, cur - prev AS change, mills, {_FLAGS} AS flags FROM v_state LEFT JOIN pair USING (code) LEFT JOIN lp USING (series), e")
def rpt01_latest_snapshot(spark, sf):
    return reports.latest_snapshot(views.states(spark, sf), views.weekly(spark, sf), views.daily(spark, sf))


@query(f", {_PAIR}, {_LAST} SELECT f AS flag, count(*) AS n FROM (SELECT unnest(string_split({_FLAGS}, ',')) AS f FROM v_state LEFT JOIN pair USING (code) LEFT JOIN lp USING (series), e) WHERE f <> '' GROUP BY 1")
def qlt04_row_flags(spark, sf):
    rows = reports.latest_snapshot(views.states(spark, sf), views.weekly(spark, sf), views.daily(spark, sf))
    return rows.select(F.explode(F.split("flags", ",")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count("*").alias("n"))


@query(", d AS (SELECT as_of, lag(as_of) OVER (ORDER BY as_of) AS b FROM (SELECT DISTINCT as_of FROM v_daily)), r AS (SELECT v.as_of, v.code, v.units, d.b, p.units AS prev FROM v_daily v JOIN d USING (as_of) LEFT JOIN v_daily p ON p.code = v.code AND p.as_of = d.b), k AS (SELECT as_of, count(*) AS n, count(DISTINCT code) AS keys, count(*) FILTER (units NOT BETWEEN 15000 AND 25000) AS bad, bool_and(units IS NOT DISTINCT FROM prev) AS same, max(as_of - b) AS gap, count(*) FILTER (prev IS NULL) AS miss, count(*) FILTER (abs(units - prev) >= 2000) AS lg, bool_or(b IS NOT NULL) AS has FROM r GROUP BY 1) SELECT as_of, n, CASE WHEN n <> 25 OR keys <> n OR bad > 0 OR (same AND has) THEN 'invalid' ELSE 'ok' END AS outcome, concat_ws(',', CASE WHEN gap > 1 THEN 'gap' END, CASE WHEN has AND miss > 0 THEN 'prev_missing' END, CASE WHEN lg > 0 THEN 'large_move' END) AS warnings FROM k")
def qlt03_check_snapshots(spark, sf):
    return relations.check_snapshots(views.daily(spark, sf), views.states(spark, sf), "code", "as_of", "units", 15000, 25000, 2000)


@query(", b AS (SELECT series FROM v_weekly WHERE period = (SELECT max(period) FROM v_weekly) AND mills IS NOT NULL) SELECT region, string_agg(code, ',' ORDER BY code) AS members, count(*) AS n FROM v_state WHERE series IS NOT NULL AND series NOT IN (SELECT series FROM b) GROUP BY 1")
def qlt06_blank_regions(spark, sf):
    return relations.blank_regions(views.states(spark, sf), views.weekly(spark, sf), "series", "period", "mills")


@query(", n AS (SELECT p_partkey, p_name AS t, '  ' || upper(split_part(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END)) || CASE WHEN p_partkey % 5 = 0 THEN '   x' ELSE '' END AS anchor FROM part) SELECT p_partkey FROM n WHERE NOT contains(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(anchor, '\\s+', ' ', 'g'))))")
def qlt07_lost_anchors(spark, sf):
    from ..functions.text import squash

    p = views._t(spark, sf, "part")
    anchor = F.concat(F.lit("  "), F.upper(F.coalesce(F.try_element_at(F.split("p_name", " "), F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(2)), F.lit(""))), F.when(F.col("p_partkey") % 5 == 0, "   x").otherwise(""))
    return p.where(~F.contains(squash(F.col("p_name")), squash(anchor))).select("p_partkey")


@query(" SELECT ts::DATE AS run, count(*) AS n, count(DISTINCT event_type) AS kinds, concat_ws('; ', 'events ' || count(*), CASE WHEN count(*) FILTER (value > 90) > 0 THEN 'high ' || count(*) FILTER (value > 90) END) AS summary FROM events GROUP BY 1")
def qlt08_run_log(spark, sf):
    high = F.count_if(F.col("value") > 90)
    e = views._t(spark, sf, "events").groupBy(F.to_date("ts").alias("run"))
    return e.agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.concat_ws("; ", F.concat(F.lit("events "), F.count("*").cast("string")), F.when(high > 0, F.concat(F.lit("high "), high.cast("string")))).alias("summary"))


@query(f", {_LAST} SELECT 'monday' AS rule, count(*) FILTER (isodow(period) <> 1) AS n FROM v_weekly UNION ALL SELECT 'unique', count(*) - count(DISTINCT (series, period)) FROM v_weekly UNION ALL SELECT 'surveyed has a price', count(*) FILTER (series IS NOT NULL AND mills IS NULL) FROM v_state LEFT JOIN lp USING (series) UNION ALL SELECT 'tax keys', count(*) FILTER (t.code IS NULL) FROM v_state s LEFT JOIN v_tax t ON t.code = s.code UNION ALL SELECT 'out of date has a rate', count(*) FILTER (out_of_date AND mils IS NULL) FROM v_tax")
def qlt02_consistency(spark, sf):
    return reports.consistency(views.states(spark, sf), views.weekly(spark, sf), views.taxes(spark, sf))


@query(f", {_PAIR}, {_LAST} SELECT s.code, s.name, s.region, cur, cur - prev AS change, round((cur - prev)::DOUBLE / prev * 100, 2) AS pct, mills, CASE WHEN NOT out_of_date THEN mils END AS mils FROM v_state s LEFT JOIN pair USING (code) LEFT JOIN lp USING (series) LEFT JOIN v_tax t ON t.code = s.code")
def rpt03_state_quotes(spark, sf):
    return reports.state_quotes(views.states(spark, sf), views.weekly(spark, sf), views.daily(spark, sf), views.taxes(spark, sf))


@query(", n AS (SELECT series, max(period) AS period, arg_max(mills, period) AS mills FROM v_weekly WHERE mills IS NOT NULL GROUP BY series), b AS (SELECT series, period AS d, mills AS v FROM v_weekly WHERE mills IS NOT NULL), p AS (SELECT n.*, n.period - 28 AS m4, n.period - 364 AS m52 FROM n) SELECT p.series, p.period, p.mills, p.mills - CASE WHEN x.d >= m4 - 6 THEN x.v END AS change_4w, p.mills - CASE WHEN y.d >= m52 - 6 THEN y.v END AS change_52w FROM p ASOF LEFT JOIN b x ON x.series = p.series AND p.m4 >= x.d ASOF LEFT JOIN b y ON y.series = p.series AND p.m52 >= y.d")
def rpt04_then_and_now(spark, sf):
    return reports.then_and_now(views.weekly(spark, sf), {"change_4w": 28, "change_52w": 364})


@query(f", {_LAST} SELECT code, name, series, mills, CASE WHEN series IS NULL THEN 'no survey' ELSE 'average of ' || (count(*) OVER (PARTITION BY series)) || ' states' END AS plate FROM v_state LEFT JOIN lp USING (series)")
def rpt13_state_lines(spark, sf):
    return reports.state_lines(views.states(spark, sf), views.weekly(spark, sf))

"""Queries for schemas, snapshots, health and moves, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from . import views
from .registered import query


@query(""" , o AS (SELECT CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE o_orderkey % 500 END AS k, o_orderstatus AS s, o_totalprice AS p FROM orders),
b AS (SELECT 'k: null' AS rule, count(*) FILTER (k IS NULL) AS n FROM o UNION ALL SELECT 's: other value', count(*) FILTER (s NOT IN ('F', 'O')) FROM o UNION ALL SELECT 'p: above 400000', count(*) FILTER (p > 400000) FROM o UNION ALL SELECT 's: other shape', count(*) FILTER (s = 'P') FROM o
UNION ALL SELECT 'k: not unique', (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM o GROUP BY k)) UNION ALL SELECT 'x: missing column', 1 UNION ALL SELECT 'fewer than 100000000 rows', 1) SELECT rule, n::BIGINT AS n, CASE rule WHEN 's: other value' THEN (SELECT string_agg(s, '|') FROM (SELECT DISTINCT s FROM o WHERE s NOT IN ('F', 'O') ORDER BY 1 LIMIT 5)) WHEN 'p: above 400000' THEN (SELECT string_agg(s, '|') FROM (SELECT DISTINCT p::VARCHAR AS s FROM o WHERE p > 400000 ORDER BY 1 LIMIT 5)) WHEN 's: other shape' THEN 'P' WHEN 'k: not unique' THEN (SELECT string_agg(v, '|') FROM (SELECT coalesce(k::VARCHAR, '') AS v FROM o GROUP BY k HAVING count(*) > 1 ORDER BY 1 LIMIT 5)) ELSE '' END AS examples FROM b WHERE n > 0""")
def qlt01_closed_schema(spark, sf):
    k = F.col("o_orderkey")
    rows = views._t(spark, sf, "orders").select(F.when(k % 11 != 3, k % 500).alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    fields = {"k": checks.Field("bigint"), "s": checks.Field("string", values=("F", "O"), pattern="^[FO]$"), "p": checks.Field("double", low=-1e12, high=400000), "x": checks.Field("int")}
    return checks.check(rows, fields, (("k",),), least=100_000_000).select("rule", "n", F.array_join("examples", "|").alias("examples"))


_NEW = """p AS (SELECT k AS page, (SELECT max(as_of) FROM v_daily) + CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN 9 ELSE 3 END AS as_of, code, CASE WHEN k = 7 AND code = 3 THEN 99999999 WHEN k = 12 OR k = 9 AND code > 0 THEN units ELSE units + k * 10 END AS price
  FROM v_daily, range(15) t(k) WHERE as_of = (SELECT max(as_of) FROM v_daily) AND NOT (k = 10 AND code = 4))"""


@query(f""", {_NEW}, m AS (SELECT max(as_of) AS before FROM v_daily), l AS (SELECT code, units AS was FROM v_daily, m WHERE as_of = before), a AS (SELECT page, p.as_of, before, count(*) AS n, bool_and(price = was) AS same, max(abs(price - was)) AS moved, max(price) > 9999999 AS bad FROM p JOIN l USING (code), m GROUP BY 1, 2, 3),
r AS (SELECT *, CASE WHEN n <> 25 THEN 'other codes' WHEN bad THEN 'price' WHEN as_of > before + 5 THEN 'date ahead' WHEN as_of < before THEN 'older' WHEN as_of > before AND same THEN 'all as before' END AS reason FROM a)
SELECT page, as_of, CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN as_of = before THEN 'noop' ELSE 'ok' END AS outcome, reason, CASE WHEN reason IS NULL THEN concat_ws(',', CASE WHEN as_of = before + 5 THEN 'as_of_ahead' END, CASE WHEN as_of > before + 1 THEN 'gap' END, CASE WHEN moved >= 100 THEN 'large_move' END) ELSE '' END AS warnings FROM r""")
def qlt03_snapshot_outcomes(spark, sf):
    d = views.daily(spark, sf)
    last = d.agg(F.max("as_of").alias("before"))
    rows = d.join(F.broadcast(last), F.col("as_of") == F.col("before")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(14))))
    k = F.col("k")
    on = F.date_add("before", F.element_at(F.array(*(F.lit(x) for x in (1, 0, -1, 9, 3))), k % 5 + 1))
    price = F.when((k == 7) & (F.col("code") == 3), 99999999).when((k == 12) | ((k == 9) & (F.col("code") > 0)), F.col("units")).otherwise(F.col("units") + k * 10)
    pages = rows.where("NOT (k = 10 AND code = 4)").select(k.cast("long").alias("page"), on.alias("as_of"), "code", price.alias("price"))
    day = last.first()["before"]
    codes = views.states(spark, sf).select("code")
    today = F.date_add(F.lit(day), 4)
    return checks.snapshot_outcomes(pages, d.select("as_of", "code", F.col("units").alias("price")), codes, today, 0, 9_999_999, 100).withColumn("warnings", F.array_join("warnings", ","))


@query(""" , d AS (SELECT series AS dataset, CASE WHEN series <> 'R4' THEN max(period) FILTER (mills IS NOT NULL) END AS newest, CASE WHEN series = 'R1' THEN 9 ELSE 100000 END AS stale_days, series IN ('R2', 'R3') AS fallback FROM v_weekly GROUP BY 1), a AS (SELECT *, DATE '2026-01-01' - newest AS age FROM d)
SELECT dataset, newest, age, concat_ws(',', CASE WHEN newest IS NULL THEN 'no data' END, CASE WHEN age > stale_days THEN 'stale' END, CASE WHEN dataset = 'R2' THEN 'fallback' END, CASE WHEN dataset = 'R0' THEN 'no status' END) AS problems FROM a""")
def qlt05_dataset_health(spark, sf):
    w = views.weekly(spark, sf)
    newest = F.max(F.when(F.col("mills").isNotNull(), F.col("period")))
    sets = w.groupBy(F.col("series").alias("dataset")).agg(newest.alias("newest"))
    sets = sets.select("dataset", F.when(F.col("dataset") != "R4", F.col("newest")).alias("newest"), F.when(F.col("dataset") == "R1", 9).otherwise(100_000).alias("stale_days"), F.lit(False).alias("inclusive"), F.when(F.col("dataset").isin("R2", "R3"), "fallback").otherwise("primary").alias("source"))
    runs = w.where("series <> 'R0'").select(F.col("series").alias("dataset"), F.date_add("period", 400).alias("day"), F.when(F.col("series") == "R2", "failed").otherwise("ok").alias("status"))
    return checks.dataset_health(sets, runs, F.lit("2026-01-01").cast("date")).withColumn("problems", F.array_join("problems", ","))


@query(" SELECT p_partkey AS id, p_size AS old, p_size + p_partkey % 23 - 11 AS new, p_partkey % 4 > 0 AS blocks FROM part WHERE p_partkey % 7 > 0 AND abs(p_partkey % 23 - 11) > 10")
def win14_big_moves(spark, sf):
    p = views._t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))
    new = p.withColumn("size", F.when(F.col("id") % 7 > 0, F.col("size") + F.col("id") % 23 - 11))
    return checks.big_moves(p, new, "id", "size", 10, p.where("id % 4 = 0").select("id"))


_WEEKS = "w AS (SELECT series, period, mills, dense_rank() OVER (ORDER BY period DESC) AS k FROM v_weekly QUALIFY k <= 4)"


@query(f", {_WEEKS} SELECT series, max(mills) FILTER (k = 1) AS week_1, max(mills) FILTER (k = 2) AS week_2, max(mills) FILTER (k = 3) AS week_3, max(mills) FILTER (k = 4) AS week_4, max(mills) FILTER (k = 1) - max(mills) FILTER (k = 4) AS change FROM w GROUP BY 1")
def rpt06_four_weeks(spark, sf):
    from .reports import newest_weeks

    return newest_weeks(views.weekly(spark, sf), 4)

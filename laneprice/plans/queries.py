"""One query for each operator over the given tables, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, money
from ..operators import boards, relations, series, spatial
from . import reports, views
from .registered import query

W = (["series"], "period", "mills")

_TAIL = "(SELECT *, max(period) FILTER (mills IS NOT NULL) OVER (PARTITION BY series) AS newest, min(period) FILTER (mills IS NOT NULL) OVER (PARTITION BY series) AS first FROM v_weekly)"


@query(" SELECT series, period, mills FROM v_weekly")
def weekly_prices(spark, sf):
    return views.weekly(spark, sf)


@query(", p AS (SELECT *, lag(mills) OVER (PARTITION BY series ORDER BY period) AS prev FROM v_weekly) SELECT series, period, mills AS price, prev, mills - prev AS change, round(CASE WHEN prev <> 0 THEN (mills - prev)::DOUBLE / prev * 100 END, 2) AS change_pct, CASE WHEN mills > prev THEN 'up' WHEN mills < prev THEN 'down' WHEN mills = prev THEN 'flat' END AS direction FROM p")
def win01_moves(spark, sf):
    return series.moves(views.weekly(spark, sf), ["series"], "period", F.col("mills"), 0).withColumn("change_pct", F.col("change_pct").cast("double"))


@query(" SELECT series, max(period) AS period, arg_max(mills, period) AS mills FROM v_weekly WHERE mills IS NOT NULL GROUP BY series")
def win03_newest(spark, sf):
    return series.newest(views.weekly(spark, sf), *W)


@query(f", n AS (SELECT series, max(period) AS period, arg_max(mills, period) AS mills FROM v_weekly WHERE mills IS NOT NULL GROUP BY series), b AS (SELECT n.series, arg_max(w.mills, w.period) AS base FROM n JOIN v_weekly w ON w.series = n.series AND w.mills IS NOT NULL AND w.period <= n.period - 28 AND w.period >= n.period - 28 - 6 GROUP BY 1) SELECT n.*, base, mills - base AS change FROM n LEFT JOIN b USING (series)")
def win04_change_over(spark, sf):
    return series.change_over(views.weekly(spark, sf), *W, days=28)


@query(f", t AS (SELECT * FROM {_TAIL} WHERE mills IS NOT NULL AND period > newest - 364) SELECT series, max(mills) AS high, arg_max(period, mills * 100000 + (period - DATE '1970-01-01')) AS high_on, min(mills) AS low, arg_min(period, mills * 100000 - (period - DATE '1970-01-01')) AS low_on, bool_or(newest - first >= 357) AS complete FROM t GROUP BY series")
def win05_high_low(spark, sf):
    return series.high_low(views.weekly(spark, sf), *W)


@query(" SELECT series, period, mills FROM (SELECT *, max(period) OVER (PARTITION BY series) AS m FROM v_weekly) WHERE period > m - 364")
def win06_last_days(spark, sf):
    return series.last_days(views.weekly(spark, sf), ["series"], "period", 364)


@query(f", t AS (SELECT * FROM {_TAIL} WHERE mills IS NOT NULL), n AS (SELECT * FROM t WHERE period = newest) SELECT n.series, n.period, n.mills, CASE WHEN n.mills > max(t.mills) THEN 'record' WHEN n.mills > max(t.mills) FILTER (t.period > n.period - 364) THEN '52week' END AS kind FROM n LEFT JOIN t ON t.series = n.series AND t.period < n.period GROUP BY 1, 2, 3")
def win07_peak_kind(spark, sf):
    return series.peak_kind(views.weekly(spark, sf), *W)


@query(f", t AS (SELECT * FROM {_TAIL} WHERE mills IS NOT NULL AND period > newest - 364) SELECT series, min(mills) AS low, arg_min(period, mills * 100000 + (period - DATE '1970-01-01')) AS low_on, max(mills) AS high, arg_max(period, mills * 100000 + (period - DATE '1970-01-01')) AS high_on, arg_max(mills, period) AS last FROM t GROUP BY series HAVING count(*) >= 2")
def win08_spark_range(spark, sf):
    return series.spark_range(views.weekly(spark, sf), *W)


@query(", s AS (SELECT series, unnest(generate_series(min(period), max(period), INTERVAL 7 DAYS))::DATE AS period FROM v_weekly WHERE mills IS NOT NULL GROUP BY series), p AS (SELECT * FROM v_weekly WHERE mills IS NOT NULL) SELECT series, period, mills FROM s LEFT JOIN p USING (series, period)")
def win09_densify(spark, sf):
    return series.densify(views.weekly(spark, sf).where("mills IS NOT NULL"), *W)


@query(", s AS (SELECT series, unnest(generate_series(min(period), max(period), INTERVAL 1 DAY))::DATE AS period FROM v_weekly GROUP BY series), p AS (SELECT series, period AS d, mills::DOUBLE AS v FROM v_weekly WHERE mills IS NOT NULL), j AS (SELECT s.*, a.d AS ad, a.v AS av, b.d AS bd, b.v AS bv FROM s ASOF LEFT JOIN p a ON a.series = s.series AND s.period >= a.d ASOF LEFT JOIN p b ON b.series = s.series AND s.period <= b.d) SELECT series, period, round(CASE WHEN ad IS NULL THEN bv WHEN bd IS NULL OR ad = bd THEN av ELSE av + (bv - av) * ((period - ad)::DOUBLE / (bd - ad)) END, 6) AS mills FROM j")
def win10_interpolate_daily(spark, sf):
    return series.interpolate_daily(views.weekly(spark, sf), *W).withColumn("mills", F.round("mills", 6))


@query(" SELECT code, as_of, units, as_of - lag(as_of) OVER (PARTITION BY code ORDER BY as_of) AS gap FROM v_daily")
def win13_gap_days(spark, sf):
    return series.gap_days(views.daily(spark, sf), ["code"], "as_of")


@query(", r AS (SELECT code, rank() OVER (ORDER BY mils DESC) AS from_top, rank() OVER (ORDER BY mils) AS from_bottom, count(*) OVER () AS n_ranked FROM v_tax WHERE mils IS NOT NULL AND NOT out_of_date) SELECT code, name, mils, out_of_date, from_top, from_bottom, n_ranked, CASE WHEN NOT out_of_date THEN mils + 24400 END AS total_mils FROM v_state JOIN v_tax USING (code) LEFT JOIN r USING (code)")
def win12_tax_panel(spark, sf):
    return reports.tax_panel(views.states(spark, sf), views.taxes(spark, sf), 24400)


@query(", m AS (SELECT as_of, code, units, CASE WHEN units % 3 = 0 THEN NULL WHEN units % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM v_daily), k AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY code ORDER BY as_of) = kind THEN 0 ELSE 1 END AS new FROM m WHERE kind IS NOT NULL), r AS (SELECT *, sum(new) OVER (PARTITION BY code ORDER BY as_of)::BIGINT AS run FROM k) SELECT code, run, kind, min(as_of) AS begin, max(as_of) AS \"end\" FROM r GROUP BY 1, 2, 3")
def win16_islands(spark, sf):
    rows = views.daily(spark, sf).withColumn("kind", F.expr("CASE WHEN units % 3 = 0 THEN NULL WHEN units % 2 = 0 THEN 'even' ELSE 'odd' END"))
    return series.islands(rows, ["code"], "as_of", "kind")


@query(", s AS (SELECT as_of, code, units * 100.0::DOUBLE / sum(units) OVER (PARTITION BY as_of) AS share FROM v_daily), f AS (SELECT *, floor(share)::BIGINT AS fl, 100 - (sum(floor(share)) OVER (PARTITION BY as_of))::BIGINT AS lft, row_number() OVER (PARTITION BY as_of ORDER BY share - floor(share) DESC, code) AS r FROM s) SELECT as_of, code, round(share, 6) AS share, fl + (r <= lft)::BIGINT AS units FROM f")
def win15_largest_remainder(spark, sf):
    from pyspark.sql import Window

    rows = views.daily(spark, sf).select("as_of", "code", (F.col("units") * 100.0 / F.sum("units").over(Window.partitionBy("as_of"))).alias("share"))
    return series.largest_remainder(rows, ["as_of"], "share", ["code"], F.lit(100)).withColumn("share", F.round("share", 6))


@query(", s AS (SELECT d.*, s.series FROM v_daily d JOIN v_state s USING (code) WHERE s.series IS NOT NULL) SELECT s.series, s.code, s.as_of, s.units, w.mills FROM s ASOF LEFT JOIN v_weekly w ON w.series = s.series AND s.as_of >= w.period")
def jon06_as_of(spark, sf):
    return reports.numbers_table(views.daily(spark, sf), views.weekly(spark, sf), views.states(spark, sf))


@query(", l AS (SELECT series, max(period) AS period, arg_max(mills, period) FILTER (true) AS m FROM v_weekly GROUP BY 1) SELECT s.code, s.name, s.region, s.series, w.period, w.mills FROM v_state s LEFT JOIN l USING (series) LEFT JOIN v_weekly w ON w.series = l.series AND w.period = l.period")
def jon01_state_prices(spark, sf):
    return relations.latest_prices(views.states(spark, sf), views.weekly(spark, sf), "series", "period")


@query(", s AS (SELECT a.code, b.code AS mate FROM v_state a JOIN v_state b ON a.series = b.series AND a.code <> b.code) SELECT * FROM s UNION ALL SELECT a.code, b.code FROM v_state a JOIN v_state b ON a.region = b.region AND a.code <> b.code WHERE a.code NOT IN (SELECT code FROM s)")
def jon03_region_mates(spark, sf):
    return relations.region_mates(views.states(spark, sf), "code", "series", "region")


_H = "2 * 6371000.0::DOUBLE * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@query(f" SELECT a.id AS id_a, b.id AS id_b, round({_H}, 3) AS metres FROM v_point a JOIN v_point b ON a.id < b.id AND abs(a.lat - b.lat) < 0.004 WHERE {_H} <= 300")
def jon08_distance_join(spark, sf):
    p = views.points(spark, sf)
    return spatial.distance_join(p, p, 300.0).where("id_a < id_b").withColumn("metres", F.round("metres", 3))


@query(" SELECT p.id, min(c.code) AS code FROM v_point p JOIN v_cell c ON p.lat >= lat0 AND p.lat < lat0 + 4.8::DOUBLE AND p.lon >= lon0 AND p.lon < lon0 + 11.4::DOUBLE GROUP BY 1")
def jon10_point_in_polygon(spark, sf):
    c = views.cells(spark, sf)
    corner = lambda i, j: F.struct((F.col("lon0") + 11.4 * i).alias("x"), (F.col("lat0") + 4.8 * j).alias("y"))
    ring = [corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)]
    sides = F.explode(F.array(*(F.struct(ring[k].alias("p"), ring[(k + 1) % 4].alias("q")) for k in range(4))))
    edges = c.select("code", sides.alias("e")).select("code", F.lit(0).alias("ring"), F.lit(False).alias("is_hole"), F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))
    return spatial.locate(views.points(spark, sf), edges)


@query(f", hit AS (SELECT DISTINCT a.id FROM (SELECT * FROM v_point WHERE id % 3 = 0) a JOIN (SELECT * FROM v_point WHERE id % 3 > 0) b ON abs(a.lat - b.lat) < 0.006 WHERE {_H} <= 500) SELECT brand, count(*) AS official, count(hit.id) AS matched, round(count(hit.id)::DOUBLE / count(*), 3) AS share FROM (SELECT * FROM v_point WHERE id % 3 = 0) p LEFT JOIN hit USING (id) GROUP BY ROLLUP (brand)")
def agg04_coverage(spark, sf):
    p = views.points(spark, sf)
    return spatial.coverage_share(p.where("id % 3 = 0"), p.where("id % 3 > 0"), "brand", 500.0)


@query(" SELECT brand, count(*) AS n FROM v_point WHERE lat BETWEEN 30 AND 40 AND lon BETWEEN -110 AND -90 GROUP BY 1 UNION ALL SELECT DISTINCT brand, 0 FROM v_point WHERE brand NOT IN (SELECT brand FROM v_point WHERE lat BETWEEN 30 AND 40 AND lon BETWEEN -110 AND -90)")
def agg01_count_by(spark, sf):
    p = views.points(spark, sf)
    return relations.count_by(p, p.where(spatial.in_box(F.col("lat"), F.col("lon"), -110, 30, -90, 40)), "brand")


_M = "m AS (SELECT series, period, mills - lag(mills) OVER (PARTITION BY series ORDER BY period) AS change FROM v_weekly)"


def _moved(spark, sf):
    return series.moves(views.weekly(spark, sf), ["series"], "period", F.col("mills"), 0).select("series", "period", "change")


@query(f", {_M} SELECT period, count(*) FILTER (change > 0) AS up, count(*) FILTER (change < 0) AS down, count(*) FILTER (change = 0) AS flat, min(change) FILTER (change > 0) AS least_up, max(change) FILTER (change > 0) AS most_up, min(-change) FILTER (change < 0) AS least_down, max(-change) FILTER (change < 0) AS most_down FROM m GROUP BY 1")
def agg05_direction_counts(spark, sf):
    return relations.direction_counts(_moved(spark, sf), ["period"], "change")


@query(f", {_M}, r AS (SELECT *, sign(change)::INTEGER AS sign, rank() OVER (PARTITION BY period, sign(change) ORDER BY abs(change) DESC) AS r FROM m WHERE change <> 0) SELECT period, sign, max(abs(change)) AS move, string_agg(series, ',' ORDER BY series) AS names FROM r WHERE r = 1 GROUP BY 1, 2")
def agg06_leaders(spark, sf):
    return relations.leaders(_moved(spark, sf), ["period"], "change", "series")


@query(" SELECT as_of, round(floor(avg(units) / 10 + 0.5)::DOUBLE / 1000, 3) AS average FROM v_daily GROUP BY 1")
def agg08_national_average(spark, sf):
    return boards.national_average(views.daily(spark, sf), ["as_of"], "units")


@query(", n AS (SELECT * FROM v_weekly WHERE period > DATE '1999-01-04') SELECT series, period, -mills AS mills FROM n UNION ALL SELECT * FROM v_weekly WHERE period NOT IN (SELECT period FROM n)")
def mrg01_replace_periods(spark, sf):
    w = views.weekly(spark, sf)
    return relations.replace_periods(w, w.where("period > DATE '1999-01-04'").withColumn("mills", -F.col("mills")))


@query(" SELECT brand, id, name FROM (SELECT brand, id, name, row_number() OVER (PARTITION BY brand, id % 40 ORDER BY name, id) AS n, id % 40 AS k FROM v_point) WHERE n = 1")
def mrg04_first_by_precedence(spark, sf):
    p = views.points(spark, sf).select("brand", "id", "name", (F.col("id") % 40).alias("k"))
    return relations.first_by_precedence(p, ["brand", "k"], [F.col("name"), F.col("id")]).drop("k")


@query(", a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 25) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'unknown' WHEN a.k IS NULL THEN 'missing' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k")
def mrg05_keyset_diff(spark, sf):
    a = views._t(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k"))
    return relations.keyset_diff(a, views._t(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("k")), "k")


@query(", p AS (SELECT brand, floor(lat * 100)::BIGINT AS lat, floor(lon * 100)::BIGINT AS lon, id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 2 = 0 THEN 'e' ELSE 'w' END AS d FROM v_point) SELECT brand, lat, lon, CASE WHEN count(DISTINCT coalesce(d, '')) = 1 THEN min(d) END AS direction, string_agg(id, ',' ORDER BY id) AS rows FROM p GROUP BY 1, 2, 3")
def mrg07_fold_pins(spark, sf):
    p = views.points(spark, sf).select("brand", F.floor(F.col("lat") * 100).alias("lat"), F.floor(F.col("lon") * 100).alias("lon"), "id", F.expr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 2 = 0 THEN 'e' ELSE 'w' END AS d"))
    return relations.fold_pins(p, ["brand", "lat", "lon"], "d", "id").withColumn("rows", F.array_join("rows", ","))


_LESS = "SELECT * FROM v_weekly WHERE series <> 'R0' OR period <> DATE '1999-01-04'"


@query(f" SELECT 'same' AS part, NOT EXISTS (FROM v_weekly EXCEPT ALL FROM v_weekly) AS equal UNION ALL SELECT 'less', NOT EXISTS (FROM v_weekly EXCEPT ALL {_LESS}) AND NOT EXISTS ({_LESS} EXCEPT ALL FROM v_weekly)")
def mrg03_content_equal(spark, sf):
    w = views.weekly(spark, sf).withColumn("stamp", F.lit("now"))
    told = lambda part, other: relations.content_equal(w, other.withColumn("stamp", F.lit("then")), ignore=("stamp",)).select(F.lit(part).alias("part"), "equal")
    return told("same", w).unionByName(told("less", w.where("series <> 'R0' OR period <> DATE '1999-01-04'")))


@query(" SELECT id, brand, name, lat, lon FROM (SELECT *, row_number() OVER (ORDER BY lat DESC, id) AS r FROM v_point) WHERE r <= 50 OR id % 97 = 0")
def srt02_top_or_flagged(spark, sf):
    return relations.top_or_flagged(views.points(spark, sf), 50, [F.desc("lat"), F.col("id")], F.col("id") % 97 == 0)


@query(" SELECT series, period, mills FROM v_weekly WHERE period IN (SELECT DISTINCT period FROM v_weekly ORDER BY 1 DESC LIMIT 53)")
def srt03_newest_n(spark, sf):
    return relations.newest_n(views.weekly(spark, sf), "period", 53)


@query(", a AS (SELECT code, units AS old FROM v_daily WHERE as_of = (SELECT min(as_of) FROM v_daily)), b AS (SELECT code, units AS new FROM v_daily WHERE as_of = (SELECT max(as_of) FROM v_daily)) SELECT code, old, new FROM a JOIN b USING (code) WHERE abs(new - old) > 200")
def win14_largest_moves(spark, sf):
    d = views.daily(spark, sf)
    ends = d.groupBy("code").agg(F.min_by(F.struct("as_of", "units"), "as_of").alias("a"), F.max_by(F.struct("as_of", "units"), "as_of").alias("b"))
    span = d.agg(F.min("as_of").alias("x"), F.max("as_of").alias("y"))
    both = ends.join(F.broadcast(span), F.expr("a.as_of = x OR b.as_of = y"))
    old, new = both.where("a.as_of = x").select("code", "a.units"), both.where("b.as_of = y").select("code", "b.units")
    return relations.largest_moves(old, new, "code", "units", 200)


@query(" SELECT series, max(period) AS newest, DATE '2001-11-08' - max(period) AS age, DATE '2001-11-08' - max(period) >= 10 AS stale FROM v_weekly WHERE mills IS NOT NULL GROUP BY 1")
def qlt05_freshness(spark, sf):
    return relations.freshness(views.weekly(spark, sf).where("mills IS NOT NULL"), "series", "period", F.lit("2001-11-08").cast("date"), 10)


@query(" SELECT 'monday' AS rule, count(*) FILTER (isodow(period) <> 1) AS n FROM v_weekly UNION ALL SELECT 'range', count(*) FILTER (NOT coalesce(mills BETWEEN 1500 AND 2600, false)) FROM v_weekly UNION ALL SELECT 'series', count(*) FILTER (NOT regexp_matches(series, '^R[0-4]$')) FROM v_weekly")
def qlt01_violations(spark, sf):
    return relations.violations(views.weekly(spark, sf), {"monday": F.weekday("period") == 0, "range": F.col("mills").between(1500, 2600), "series": F.col("series").rlike("^R[0-4]$")})


@query(", g AS (SELECT unnest([2000, 2500]) AS base), h AS (SELECT unnest([5.5, 6.0, 7.0])::DOUBLE AS mpg) SELECT series, period, mills, base, mpg, CASE WHEN mills IS NULL THEN NULL WHEN mills <= base THEN 0 ELSE floor((mills - base) / mpg + 0.5 + 1e-9)::BIGINT END AS tenths FROM v_weekly, g, h WHERE period IN (SELECT DISTINCT period FROM v_weekly ORDER BY 1 DESC LIMIT 53)")
def rpt06_surcharge_table(spark, sf):
    return reports.surcharge_table(views.weekly(spark, sf), [2000, 2500], [5.5, 6.0, 7.0], 53)


@query(f", {_M}, t AS (SELECT * FROM {_TAIL} WHERE mills IS NOT NULL), l AS (SELECT series, max(period) AS period FROM v_weekly GROUP BY 1), r AS (SELECT series, min(mills) AS low, max(mills) AS high FROM t WHERE period > newest - 364 GROUP BY 1 HAVING count(*) >= 2), k AS (SELECT n.series, CASE WHEN n.mills > max(t.mills) THEN 'record' WHEN n.mills > max(t.mills) FILTER (t.period > n.period - 364) THEN '52week' END AS kind FROM (SELECT * FROM t WHERE period = newest) n LEFT JOIN t ON t.series = n.series AND t.period < n.period GROUP BY n.series, n.mills, n.period), s AS (SELECT series, string_agg(code, ',' ORDER BY code) AS members, count(*) AS n_members FROM v_state WHERE series IS NOT NULL GROUP BY 1) SELECT l.series, l.period, w.mills AS price, m.change, CASE WHEN m.change > 0 THEN 'up' WHEN m.change < 0 THEN 'down' WHEN m.change = 0 THEN 'flat' END AS direction, low, high, kind, members, n_members FROM l JOIN v_weekly w USING (series, period) JOIN m USING (series, period) LEFT JOIN r USING (series) LEFT JOIN k USING (series) LEFT JOIN s USING (series)")
def rpt02_region_board(spark, sf):
    return reports.region_board(views.weekly(spark, sf), views.states(spark, sf))


@query(f", {_M} SELECT series, period, CASE WHEN change > 0 THEN '+' WHEN change < 0 THEN '−' ELSE '' END || (abs(change) // 10) || '.' || (abs(change) % 10) || '¢' AS words, (sign(change) * CASE WHEN abs(change) < 10 THEN 0 WHEN abs(change) < 50 THEN 1 WHEN abs(change) < 150 THEN 2 WHEN change IS NOT NULL THEN 3 END)::INTEGER AS bin FROM m WHERE change IS NOT NULL")
def cls08_change_bins(spark, sf):
    return _moved(spark, sf).where("change IS NOT NULL").select("series", "period", money.signed_cents(F.col("change")).alias("words"), money.bin_change(F.col("change"), (10, 50, 150)).alias("bin"))


@query(" SELECT as_of, code, '$' || (((units + 5) // 10) // 1000) || '.' || lpad((((units + 5) // 10) % 1000)::VARCHAR, 3, '0') AS price, (code + 1) || CASE WHEN (code + 1) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN (code + 1) % 10 = 1 THEN 'st' WHEN (code + 1) % 10 = 2 THEN 'nd' WHEN (code + 1) % 10 = 3 THEN 'rd' ELSE 'th' END AS place FROM v_daily")
def scl02_formats(spark, sf):
    return views.daily(spark, sf).select("as_of", "code", money.format_price(money.to_mills(F.col("units"))).alias("price"), money.ordinal(F.col("code") + 1).alias("place"))


@query(f" SELECT a.id, round({_H.replace('6371000.0', '3958.7613')}, 6) AS miles, round((degrees(atan2(sin(radians(b.lon) - radians(a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon) - radians(a.lon)))) + 360) % 360, 6) AS bearing FROM v_point a JOIN v_point b ON b.id = a.id + 1")
def scl14_distances(spark, sf):
    p = views.points(spark, sf)
    q = p.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.join(q, "id").select("id", F.round(geo.miles("lat", "lon", "lat2", "lon2"), 6).alias("miles"), F.round(geo.bearing("lat", "lon", "lat2", "lon2"), 6).alias("bearing"))

"""Queries for boards with their notes, the past year of every state, towns, rings, release dates and run logs, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards, lines, relations, series
from ..sources import documents
from . import reports, views
from .queries_board import _LAST, _PAIR
from .queries_places import _BETWEEN, _SAMPLES, _SIDE, _samples
from .registered import query

_U = "v_us AS (SELECT series, period, mills FROM v_weekly UNION ALL SELECT 'US', period, sum(mills)::BIGINT // nullif(count(mills), 0) FROM v_weekly GROUP BY period)"
_CHANGE = "c AS (SELECT series, period, mills - lag(mills) OVER (PARTITION BY series ORDER BY period) AS change FROM v_weekly)"
#: Moves of the states, each with its series.
_MOVED = f"{_CHANGE}, m AS (SELECT period, name, code = 8 AS apart, change, CASE WHEN abs(change) < 10 THEN 0 ELSE sign(change)::INTEGER END AS sign FROM c JOIN v_state USING (series) WHERE change IS NOT NULL)"


def _ranked(rows: str) -> str:
    return f"""a AS (SELECT *, row_number() OVER (PARTITION BY period, sign ORDER BY abs(change) DESC, name) AS place, count(*) OVER (PARTITION BY period, sign, abs(change)) AS tied, max(abs(change)) OVER (PARTITION BY period, sign) AS top,
  min(abs(change)) OVER (PARTITION BY period, sign) AS least, max(sign) OVER (PARTITION BY period) - min(sign) OVER (PARTITION BY period) AS ways FROM {rows}),
mv AS (SELECT period, sign, place, name, change, tied, abs(change) = top AS leads, ways = 0 AND abs(change) = least AND least < top AS trails FROM a WHERE sign <> 0)"""


def _words(names: str, n: str) -> str:
    return f"CASE WHEN {n} = 1 THEN {names}[1] ELSE array_to_string({names}[:{n} - 1], ', ') || ' and ' || {names}[{n}] END"


_NOTE = f"""ends AS (SELECT period, sign, leads, trails, change, max(tied) AS n, list(name ORDER BY name) AS names FROM mv WHERE leads OR trails GROUP BY ALL),
told AS (SELECT *, CASE WHEN n > 3 THEN n || ' tied' ELSE {_words('names', 'n')} END || ', ' || CASE WHEN change > 0 THEN '+' ELSE '−' END || (abs(change) // 10) || '.' || (abs(change) % 10) || '¢.' AS said FROM ends),
parts AS (SELECT period, max(said) FILTER (leads AND sign > 0) AS up, max(said) FILTER (leads AND sign < 0) AS down, max(said) FILTER (trails) AS least FROM told GROUP BY 1),
note AS (SELECT period, CASE WHEN up IS NOT NULL THEN 'Biggest rise.' ELSE 'Biggest fall.' END AS head, concat_ws(' ', up, CASE WHEN up IS NULL THEN down ELSE 'Biggest fall. ' || down END, 'Smallest, ' || least) AS text FROM parts)"""


def _line(rows: str, noun: str) -> str:
    many = lambda n, a, first: f"CASE WHEN {a} = 0 THEN {n} || CASE WHEN NOT ({first}) THEN '' WHEN {n} = 1 THEN ' {noun}' ELSE ' {noun}s' END WHEN {n} = {a} THEN 'DC' ELSE ({n} - {a}) || CASE WHEN {n} - {a} = 1 THEN ' {noun}' ELSE ' {noun}s' END || ' and DC' END"
    cents = lambda x: f"({x} // 10) || '.' || ({x} % 10) || '¢'"
    every = f"CASE WHEN n = 1 THEN CASE WHEN a = 1 THEN 'DC' ELSE 'The one {noun}' END ELSE 'All ' || {many('n', 'a', 'true')} END"
    spread = f"CASE WHEN lo = hi THEN ' ' || {cents('lo')} ELSE ', ' || {cents('lo')} || ' to ' || {cents('hi')} END"
    same = lambda n: f"CASE WHEN {n} = 1 THEN ' was about the same' ELSE ' were about the same' END"
    parts = f"[x FOR x IN [CASE WHEN u > 0 THEN {many('u', 'ua', 'true')} || ' rose' END, CASE WHEN d > 0 THEN {many('d', 'da', 'u = 0')} || ' fell' END, CASE WHEN f > 0 THEN {many('f', 'fa', 'u = 0 AND d = 0')} || {same('f')} END] IF x IS NOT NULL]"
    return f"""g AS (SELECT period, count(*) AS n, count(*) FILTER (apart) AS a, count(*) FILTER (sign > 0) AS u, count(*) FILTER (sign > 0 AND apart) AS ua, count(*) FILTER (sign < 0) AS d, count(*) FILTER (sign < 0 AND apart) AS da,
  count(*) FILTER (sign = 0) AS f, count(*) FILTER (sign = 0 AND apart) AS fa, min(abs(change)) AS lo, max(abs(change)) AS hi FROM {rows} GROUP BY 1), gp AS (SELECT *, {parts} AS ps FROM g),
line AS (SELECT period, CASE WHEN u = n THEN {every} || ' rose' || {spread} WHEN d = n THEN {every} || ' fell' || {spread} WHEN f = n THEN {every} || {same('n')} ELSE {_words('ps', 'len(ps)')} END || '.' AS line FROM gp)"""


def _moves(spark, sf):
    moved = series.moves(views.weekly(spark, sf), ["series"], "period", F.col("mills"), 0).select("series", "period", "change")
    return moved.join(F.broadcast(views.states(spark, sf).select("series", "code", "name")), "series")  # a state's row for each of 25


@query(f", {_MOVED}, {_ranked('m')} SELECT * FROM mv")
def agg06_movers(spark, sf):
    return boards.movers(_moves(spark, sf), ["period"], "change", "name", 10)


@query(f", {_MOVED}, {_ranked('m')}, {_NOTE} SELECT * FROM note")
def agg06_biggest_note(spark, sf):
    return boards.biggest_note(_moves(spark, sf), ["period"], "change", "name", 10)


@query(f", {_MOVED}, {_line('m', 'state')} SELECT * FROM line")
def agg05_key_line(spark, sf):
    return boards.key_line(_moves(spark, sf), ["period"], "change", "state", 10, F.col("code") == 8)


@query(", c AS (SELECT c_nationkey % 7 AS region, c_custkey AS code FROM customer WHERE c_acctbal > 0), g AS (SELECT region, string_agg(code, ',' ORDER BY code) AS members, count(*) AS k, count(*) FILTER (code % 500 <> 8) AS n, bool_or(code % 500 = 8) AS has_apart FROM c GROUP BY 1) SELECT region, members, n, has_apart, CASE WHEN n = 0 AND has_apart THEN 'DC' WHEN n = 0 THEN 'no states' ELSE n || CASE WHEN n = 1 THEN ' state' ELSE ' states' END || CASE WHEN has_apart THEN ' and DC' ELSE '' END END AS covers, region = (SELECT min(region) FROM g WHERE k = (SELECT max(k) FROM g)) AS largest FROM g")
def agg07_largest_region(spark, sf):
    c = views._t(spark, sf, "customer").where("c_acctbal > 0").selectExpr("c_nationkey % 7 AS region", "c_custkey AS code")
    return boards.region_members(c, "region", "code", F.col("code") % 500 == 8)


def _with_us(spark, sf):
    w = views.weekly(spark, sf)
    return w.unionByName(w.groupBy("period").agg(F.expr("sum(mills) div nullif(count(mills), 0)").alias("mills")).withColumn("series", F.lit("US")))


def _peaks(rows: str) -> str:
    return f"""pt AS (SELECT *, max(period) OVER (PARTITION BY series) AS newest FROM {rows} WHERE mills IS NOT NULL),
pk AS (SELECT n.series, CASE WHEN n.mills > max(t.mills) THEN 'record' WHEN n.mills > max(t.mills) FILTER (t.period > n.period - 364) THEN '52week' END AS kind FROM (SELECT * FROM pt WHERE period = newest) n LEFT JOIN pt t ON t.series = n.series AND t.period < n.period GROUP BY n.series, n.mills, n.period)"""


def _covers(n: str, a: str) -> str:
    return f"CASE WHEN {n} = 0 AND {a} THEN 'DC' WHEN {n} = 0 THEN 'no states' ELSE {n} || CASE WHEN {n} = 1 THEN ' state' ELSE ' states' END || CASE WHEN {a} THEN ' and DC' ELSE '' END END"


@query(f""", {_U}, {_peaks('v_us')}, mo AS (SELECT series, period, mills, mills - lag(mills) OVER (PARTITION BY series ORDER BY period) AS change, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS k FROM v_us),
r AS (SELECT series, min(mills) AS low, max(mills) AS high FROM pt WHERE period > newest - 364 GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT series, string_agg(code, ',' ORDER BY code) AS members, count(*) AS n_members, count(*) FILTER (code <> 8) AS n, bool_or(code = 8) AS a FROM v_state WHERE series IS NOT NULL GROUP BY 1),
e AS (SELECT count(*) FILTER (code <> 8) AS n, coalesce(bool_or(code = 8), false) AS a FROM v_state WHERE series IS NOT NULL)
SELECT series, period, mills AS price, change, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' WHEN change = 0 THEN 'flat' END AS direction, low, high, kind, members, n_members,
  CASE WHEN series = 'US' THEN {_covers('e.n', 'e.a')} WHEN s.n IS NULL THEN 'no states' ELSE {_covers('s.n', 's.a')} END AS covers, row_number() OVER (ORDER BY (series <> 'US')::INTEGER, series) AS place
FROM mo LEFT JOIN r USING (series) LEFT JOIN pk USING (series) LEFT JOIN s USING (series), e WHERE k = 1""")  # fmt: skip
def rpt02_whole_board(spark, sf):
    return reports.whole_board(_with_us(spark, sf), views.states(spark, sf), "US", F.col("code") == 8)


@query(f""", {_CHANGE}, m AS (SELECT period, series AS name, false AS apart, change, CASE WHEN abs(change) < 10 THEN 0 ELSE sign(change)::INTEGER END AS sign FROM c WHERE change IS NOT NULL AND period = (SELECT max(period) FROM v_weekly)), {_ranked('m')}, {_NOTE}, {_line('m', 'region')}, {_peaks('v_weekly')},
x AS (SELECT count(*) FILTER (kind = 'record') AS records, count(*) AS n, list(series ORDER BY series) FILTER (kind = 'record') AS names FROM pk)
SELECT period, line, head, text, records, n, CASE WHEN records = 0 THEN NULL WHEN records = n THEN 'Every region is at its highest price' WHEN records = 1 THEN names[1] || ' is at its highest price' WHEN records <= 3 THEN {_words('names', 'records')} || ' are at their highest prices' ELSE records || ' of the ' || n || ' regions are at their highest prices' END || ' in our records, which start 1995.' AS note FROM line LEFT JOIN note USING (period), x""")  # fmt: skip
def rpt02_board_notes(spark, sf):
    return reports.board_notes(views.weekly(spark, sf), "region", "1995")


@query(""", pt AS (SELECT user_id, as_of, v FROM (SELECT user_id, ts::DATE AS as_of, floor(sum(round(value * 100)::BIGINT) / 100)::BIGINT AS v FROM events GROUP BY 1, 2)), n AS (SELECT user_id, max(as_of) AS d, arg_max(v, as_of) AS v FROM pt GROUP BY 1),
pk AS (SELECT n.user_id, n.user_id % 10 AS g, coalesce(n.v > max(p.v), false) AS rec FROM n LEFT JOIN pt p ON p.user_id = n.user_id AND p.as_of < n.d GROUP BY n.user_id, n.v),
x AS (SELECT g, count(*) FILTER (rec) AS records, count(*) AS n, list(user_id ORDER BY user_id) FILTER (rec) AS names FROM pk GROUP BY 1)
SELECT g, records, n, CASE WHEN records = 0 THEN NULL WHEN records = n THEN 'Every user is at its highest price' WHEN records = 1 THEN names[1] || ' is at its highest price' WHEN records <= 3 THEN array_to_string(names[:records - 1], ', ') || ' and ' || names[records] || ' are at their highest prices' ELSE records || ' of the ' || n || ' users are at their highest prices' END || ' in our records, which start 2024.' AS note FROM x""")  # fmt: skip
def agg11_record_notes(spark, sf):
    e = views._t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("as_of")).agg(F.expr("sum(cast(round(value * 100) AS long)) div 100").alias("v"))
    kinds = series.peak_kind(e, ["user_id"], "as_of", "v").withColumn("g", F.col("user_id") % 10)
    return boards.record_note(kinds, ["g"], "kind", "user_id", "user", "2024")


_NAT = "nat AS (SELECT as_of, floor(avg(units) / 10 + 0.5)::BIGINT AS mills FROM v_daily GROUP BY 1), dd AS (SELECT max(as_of) AS as_of, (SELECT max(as_of) FROM nat WHERE as_of < (SELECT max(as_of) FROM nat)) AS prev_as_of FROM nat), ww AS (SELECT max(period) AS period, (SELECT max(period) FROM v_weekly WHERE period < (SELECT max(period) FROM v_weekly)) AS prev_period FROM v_weekly), wk AS (SELECT ww.*, a.mills AS us, b.mills AS us_prev, a.mills - b.mills AS us_change FROM ww LEFT JOIN v_us a ON a.series = 'US' AND a.period = ww.period LEFT JOIN v_us b ON b.series = 'US' AND b.period = ww.prev_period)"


@query(f", {_U}, {_NAT} SELECT 'on' AS switch, 'daily' AS mode, dd.as_of, dd.prev_as_of, dd.as_of - dd.prev_as_of AS gap_days, x.mills AS national, y.mills AS national_prev, x.mills - y.mills AS national_change, wk.* FROM dd LEFT JOIN nat x ON x.as_of = dd.as_of LEFT JOIN nat y ON y.as_of = dd.prev_as_of, wk UNION ALL SELECT 'off', 'weekly', NULL, NULL, NULL, NULL, NULL, NULL, wk.* FROM wk")
def rpt01_country_block(spark, sf):
    national = views.daily(spark, sf).groupBy("as_of").agg(F.floor(F.avg("units") / 10 + 0.5).alias("mills"))
    w = _with_us(spark, sf)
    return reports.country_block(national, w, "US", True).withColumn("switch", F.lit("on")).unionByName(reports.country_block(national, w, "US", False).withColumn("switch", F.lit("off")))


def _past(p: str, rows: str, key: str, on: str, value: str, tolerance: int) -> str:
    day = "(s.d - DATE '1970-01-01')"
    return f"""{p}s AS (SELECT {key} AS k, {on} AS d, {value} AS v FROM {rows} WHERE {value} IS NOT NULL), {p}n AS (SELECT k, max(d) AS d, arg_max(v, d) AS v, min(d) AS f FROM {p}s GROUP BY 1),
{p} AS (SELECT n.k, n.v AS price, n.d - n.f >= 357 AS complete, n.f AS first, n.v - arg_max(s.v, s.d) FILTER (s.d BETWEEN n.d - 28 - {tolerance} AND n.d - 28) AS c4, n.v - arg_max(s.v, s.d) FILTER (s.d BETWEEN n.d - 364 - {tolerance} AND n.d - 364) AS c52,
  max(s.v) FILTER (s.d > n.d - 364) AS high, arg_max(s.d, s.v * 100000 + {day}) FILTER (s.d > n.d - 364) AS high_on, min(s.v) FILTER (s.d > n.d - 364) AS low, arg_min(s.d, s.v * 100000 - {day}) FILTER (s.d > n.d - 364) AS low_on,
  CASE WHEN n.v > max(s.v) FILTER (s.d < n.d) THEN 'record' WHEN n.v > max(s.v) FILTER (s.d < n.d AND s.d > n.d - 364) THEN '52week' END AS kind FROM {p}n n JOIN {p}s s USING (k) GROUP BY n.k, n.v, n.d, n.f)"""


_YEAR = f"""{_past('pd', 'v_daily', 'code', 'as_of', 'units', 3)}, {_past('pw', 'v_weekly', 'series', 'period', '10 * mills', 0)},
yr AS (SELECT s.code, s.name, coalesce(d.price, w.price) AS price, coalesce(d.c4, w.c4) AS change_4w, {', '.join(f"CASE WHEN w.price IS NOT NULL AND NOT coalesce(d.complete, false) THEN w.{c} ELSE d.{c} END AS {n}" for c, n in (('c52', 'change_52w'), ('high', 'high'), ('high_on', 'high_on'), ('low', 'low'), ('low_on', 'low_on'), ('kind', 'kind'), ('complete', 'y_complete'), ('first', 'y_first')))},
  CASE WHEN d.c4 IS NOT NULL THEN 'daily' WHEN w.c4 IS NOT NULL THEN 'weekly' END AS basis_4w, CASE WHEN w.price IS NOT NULL AND NOT coalesce(d.complete, false) THEN 'weekly' WHEN d.price IS NOT NULL THEN 'daily' END AS basis FROM v_state s LEFT JOIN pd d ON d.k = s.code LEFT JOIN pw w ON w.k = s.series),
py AS (SELECT * EXCLUDE (y_complete, y_first), CASE WHEN y_complete THEN 'past year' ELSE 'since ' || y_first END AS label FROM yr)"""  # fmt: skip


@query(f", {_YEAR} SELECT * FROM py")
def rpt04_past_year(spark, sf):
    return reports.past_year(views.states(spark, sf), views.daily(spark, sf), views.weekly(spark, sf))


@query(f", {_PAIR}, {_LAST}, {_YEAR} SELECT s.code, s.name, s.region, cur, cur - prev AS change, round((cur - prev)::DOUBLE / prev * 100, 2) AS pct, mills, CASE WHEN NOT out_of_date THEN mils END AS mils, low, high, label, CASE WHEN high > low THEN round((cur - low)::DOUBLE / (high - low) * 100, 2) END AS up_range FROM v_state s LEFT JOIN pair USING (code) LEFT JOIN lp USING (series) LEFT JOIN v_tax t ON t.code = s.code JOIN py ON py.code = s.code")
def rpt03_quote_board(spark, sf):
    return reports.quote_board(views.states(spark, sf), views.weekly(spark, sf), views.daily(spark, sf), views.taxes(spark, sf))


# Codes of places in the invented list; the second one marks capitals.
_KINDS = ("PPL", "PPLA", "PPLX", "PPLC", "STM", "PPLA2")
_PLACE = f"""pl AS (SELECT c_custkey AS id, ' ' || c_name AS name, CASE WHEN c_custkey // 25 % 6 = 5 THEN 'PPLA' ELSE ([{', '.join(f"'{k}'" for k in _KINDS)}])[1 + c_nationkey % 6] END AS code, CASE WHEN c_nationkey = 7 AND c_custkey // 25 % 6 <> 5 THEN 'CA' ELSE 'US' END AS country, 'S' || (c_custkey % 27) AS state,
  CASE WHEN c_custkey % 41 = 3 THEN 'n/a' ELSE (25 + c_custkey % 25)::VARCHAR END AS lat, (-124 + c_custkey % 57)::VARCHAR AS lon, CASE WHEN c_custkey % 37 = 2 THEN '' ELSE (round(c_acctbal)::BIGINT)::VARCHAR END AS population FROM customer),
ok AS (SELECT id, trim(name) AS name, code, state, lat::DOUBLE AS lat, lon::DOUBLE AS lon, population::BIGINT AS population, code IN ('PPLA', 'PPLC') AS capital FROM pl WHERE country = 'US' AND code IN ('PPL', 'PPLA', 'PPLC', 'PPLA2') AND lat <> 'n/a' AND population <> '' AND try_cast(population AS BIGINT) > 0 AND state IN (SELECT 'S' || n_nationkey FROM nation)),
rk AS (SELECT *, row_number() OVER (ORDER BY population DESC, name, state, lat, lon, id) AS r FROM ok), kp AS (SELECT * FROM rk WHERE r <= 40 OR capital)"""  # fmt: skip


def _place_rows(spark, sf):
    c, kinds = views._t(spark, sf, "customer"), F.array(*(F.lit(k) for k in _KINDS))
    capital = F.expr("c_custkey div 25 % 6") == 5
    rows = c.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name").alias("name"), F.when(capital, "PPLA").otherwise(F.element_at(kinds, (F.col("c_nationkey") % 6 + 1).cast("int"))).alias("code"), F.when((F.col("c_nationkey") == 7) & ~capital, "CA").otherwise("US").alias("country"),
        F.concat(F.lit("S"), F.col("c_custkey") % 27).alias("state"), F.when(F.col("c_custkey") % 41 == 3, "n/a").otherwise((25 + F.col("c_custkey") % 25).cast("string")).alias("lat"), (-124 + F.col("c_custkey") % 57).cast("string").alias("lon"),
        F.when(F.col("c_custkey") % 37 == 2, "").otherwise(F.round("c_acctbal").cast("long").cast("string")).alias("population"),
    )
    return rows, views.states(spark, sf).select(F.concat(F.lit("S"), "code").alias("state")), 40, ("PPL", "PPLA", "PPLC", "PPLA2"), ("PPLA", "PPLC")


@query(f", {_PLACE} SELECT id, name, state, lat, lon, population, capital, row_number() OVER (ORDER BY population DESC, name, state, lat, lon, id) AS place FROM kp")
def srt02_places(spark, sf):
    return boards.places(*_place_rows(spark, sf), strict=False)


@query(f", {_PLACE} SELECT (SELECT count(*) FROM pl WHERE country = 'US') AS us_rows, (SELECT count(*) FROM ok) AS eligible, (SELECT least(count(*), 40) FROM ok) AS top, count(*) AS places, count(*) - (SELECT least(count(*), 40) FROM ok) AS capitals_added, count(*) FILTER (capital) AS capitals FROM kp")
def agg03_place_funnel(spark, sf):
    return boards.place_funnel(*_place_rows(spark, sf))


@query(f", {_SAMPLES}, w AS (SELECT *, lead(lat) OVER o AS nlat, lead(lon) OVER o AS nlon, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon FROM s WINDOW o AS (PARTITION BY trip_id ORDER BY n)), k AS (SELECT *, coalesce({_BETWEEN.format('lat', 'lon', 'nlat', 'nlon')}, {_BETWEEN.format('plat', 'plon', 'lat', 'lon')}) AS c FROM w), b AS (SELECT trip_id, n, {_SIDE[0][0]} AS y1, {_SIDE[0][1]} AS x1, {_SIDE[1][0]} AS y2, {_SIDE[1][1]} AS x2, row_number() OVER (PARTITION BY trip_id ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY trip_id) AS z FROM k WHERE c IS NOT NULL) SELECT trip_id, place, round(lat, 5) AS lat, round(lon, 5) AS lon FROM (SELECT trip_id, i AS place, y1 AS lat, x1 AS lon FROM b UNION ALL SELECT trip_id, 2 * z - 1 - i, y2, x2 FROM b UNION ALL SELECT trip_id, 2 * z, y1, x1 FROM b WHERE i = 0)")
def geo16_band_ring(spark, sf):
    ring = lines.band_ring(lines.corridor_band(_samples(spark, sf), 15.0))
    return ring.select("trip_id", "place", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query(", p AS (SELECT brand, floor(lat * 100)::BIGINT AS lat, floor(lon * 100)::BIGINT AS lon, id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 2 = 0 THEN 'e' ELSE 'w' END AS d, CASE WHEN id % 4 > 0 THEN list_distinct(['S' || (id % 3), 'S' || (id % 7)]) END AS h FROM v_point), u AS (SELECT brand, lat, lon, string_agg(x, ',' ORDER BY x) AS hints FROM (SELECT DISTINCT brand, lat, lon, unnest(h) AS x FROM p) GROUP BY 1, 2, 3) SELECT p.brand, p.lat, p.lon, CASE WHEN count(DISTINCT coalesce(d, '')) = 1 THEN min(d) END AS direction, string_agg(id, ',' ORDER BY id) AS rows, coalesce(any_value(u.hints), '') AS hints FROM p LEFT JOIN u ON u.brand = p.brand AND u.lat = p.lat AND u.lon = p.lon GROUP BY 1, 2, 3")
def mrg07_fold_hints(spark, sf):
    hints = F.when(F.col("id") % 4 > 0, F.array(F.concat(F.lit("S"), F.col("id") % 3), F.concat(F.lit("S"), F.col("id") % 7)))
    p = views.points(spark, sf).select("brand", F.floor(F.col("lat") * 100).alias("lat"), F.floor(F.col("lon") * 100).alias("lon"), "id", F.expr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 2 = 0 THEN 'e' ELSE 'w' END AS d"), hints.alias("h"))
    return relations.fold_pins(p, ["brand", "lat", "lon"], "d", "id", "h").withColumns({c: F.array_join(c, ",") for c in ("rows", "hints")})


#: What comes with a merge: name, last week and added mills of the primary and the fallback, whether primary gives a date.
_CASES = (("primary newer", "2001-07-02", None, 0, True), ("primary older", "2001-05-07", None, 0, True), ("primary undated", "2001-06-04", None, 0, False), ("fallback newer", None, "2001-07-02", 0, False), ("fallback alike", None, "2001-06-04", 0, False), ("fallback revised", None, "2001-06-04", 1, False), ("fallback older", None, "2001-05-07", 1, False))


@query(", e AS (SELECT (SELECT max(period) FROM v_weekly WHERE period <= DATE '2001-06-04') AS a, (SELECT max(period) FROM v_weekly WHERE period <= DATE '2001-07-02') AS b) SELECT 'primary newer' AS case, b AS newest, 'book 2' AS source, b + 1 AS release, b + 8 AS next_release, NULL AS warning FROM e UNION ALL SELECT 'primary older', a, 'book 2', a + 1, a + 8, NULL FROM e UNION ALL SELECT 'primary undated', a, 'book 2', a + 1, a + 8, 'missing' FROM e UNION ALL SELECT 'fallback newer', b, 'fallback', NULL, NULL, 'cleared' FROM e UNION ALL SELECT 'fallback alike', a, 'book', a + 1, a + 8, NULL FROM e UNION ALL SELECT 'fallback revised', a, 'fallback', a + 1, a + 8, NULL FROM e UNION ALL SELECT 'fallback older', a, 'book', a + 1, a + 8, NULL FROM e")
def mrg02_release_dates(spark, sf):
    w = views.weekly(spark, sf)
    until = lambda day, add=0: w.where(F.col("period") <= F.lit(day).cast("date")).withColumn("mills", F.col("mills") + add) if day else w.where("false")
    dated = lambda rows, source, on: rows.agg(F.max("period").alias("m")).select(F.lit(source).alias("source"), *(F.when(F.lit(on), F.date_add("m", d)).alias(c) for c, d in (("release", 1), ("next_release", 8))))
    old, out = until("2001-06-04"), None
    for name, first, second, add, has_date in _CASES:
        told = boards.release_dates(old, dated(old, "book", True), until(first), dated(until(first), "book 2", has_date), until(second, add), ["series"], "period", "mills").withColumn("case", F.lit(name))
        out = told if out is None else out.unionByName(told)
    return out


@query(", e AS (SELECT ts::DATE AS run, CASE WHEN event_type IN ('click', 'view') THEN 'daily' ELSE 'weekly' END AS source, event_type AS status, value > 50 AS changed, value > 20 AS rebuilt, CASE WHEN value > 90 THEN 'high' END AS warning, ts, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY run, source ORDER BY ts DESC, event_id DESC) AS k FROM e), l AS (SELECT run, string_agg(source || '=' || status, ',' ORDER BY source) FILTER (k = 1) AS statuses, concat_ws('; ', max('D ' || run) FILTER (k = 1 AND source = 'daily' AND changed), max('W ' || run) FILTER (k = 1 AND source = 'weekly' AND changed)) AS parts, bool_or(rebuilt) FILTER (k = 1) AS again, count(warning) AS n_warnings FROM r GROUP BY 1) SELECT run, statuses, CASE WHEN parts <> '' THEN parts WHEN again THEN 'rebuilt' ELSE 'no changes' END AS message, n_warnings FROM l")
def qlt08_run_statuses(spark, sf):
    e = views._t(spark, sf, "events").select(
        F.to_date("ts").alias("run"), F.when(F.col("event_type").isin("click", "view"), "daily").otherwise("weekly").alias("source"), F.col("event_type").alias("status"), (F.col("value") > 50).alias("changed"), F.to_date("ts").alias("as_of"),
        (F.col("value") > 20).alias("rebuilt"), F.when(F.col("value") > 90, "high").alias("warning"), F.col("ts").alias("at"), F.col("event_id").alias("id"),
    )
    return boards.run_log(e, "run", {"daily": "D", "weekly": "W"})


@query(f", {_PAIR}, {_LAST}, x AS (SELECT s.code, cur - 10 * mills AS diff FROM v_state s JOIN pair USING (code) JOIN lp USING (series)) SELECT code, diff, code || CASE WHEN diff > 0 THEN ' +' ELSE ' -' END || abs(diff) AS warning FROM x WHERE abs(diff) > 200")
def qlt08_divergence(spark, sf):
    rows = reports.latest_snapshot(views.states(spark, sf), views.weekly(spark, sf), views.daily(spark, sf)).withColumn("weekly", F.col("mills") * 10)
    return boards.divergence(rows, "code", "cur", "weekly", 200)


@query(""", p AS (SELECT *, id % 4 AS k, CASE id % 3 WHEN 0 THEN 'Weigh Station' WHEN 1 THEN 'weigh scale' ELSE 'Rest Area' END AS kind FROM v_point)
SELECT id, round(lat, 5) AS lat, round(lon, 5) AS lon, greatest(DATE '2024-01-01' + (id % 400)::INTEGER, CASE WHEN id % 5 = 0 THEN DATE '2024-06-01' END) AS edited_on FROM p WHERE k < 3 AND kind <> 'Rest Area'""")  # fmt: skip
def src13_geojson_points(spark, sf):
    k, kind = F.col("id") % 4, F.when(F.col("id") % 3 == 0, "Weigh Station").when(F.col("id") % 3 == 1, "weigh scale").otherwise("Rest Area")
    made = F.format_string('{"type": "Point", "coordinates": [%s, %s]}', "lon", "lat"), F.format_string('{"type": "MultiPoint", "coordinates": [[%s , %s, 7], [0, 0]]}', "lon", "lat")
    ms = lambda day: (F.unix_date(day).cast("long") * 86400000).cast("string")
    edit = F.create_map(F.lit("EDITED"), ms(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 400).cast("int"))), F.lit("CREATED"), F.when(F.col("id") % 5 == 0, ms(F.lit("2024-06-01").cast("date"))))
    props = F.map_concat(edit, F.create_map(F.lit("Type"), kind), F.when(k == 2, F.create_map(F.lit("Latitude"), F.col("lat").cast("string"), F.lit("long_"), F.col("lon").cast("string"))).otherwise(F.create_map(F.lit("Lat"), F.lit("n/a"))))
    rows = views.points(spark, sf).select("id", F.when(k == 0, made[0]).when(k == 1, made[1]).alias("geometry"), props.alias("props"))
    found = documents.geojson_points(rows, documents.property_test("Type", "startswith", "WEIGH"), ("EDITED", "CREATED"))
    return found.select("id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "edited_on")


@query(""", n AS (SELECT c_custkey AS k, c_mktsegment || '  ' || c_nationkey AS anchor, CASE WHEN c_custkey % 7 = 0 THEN '2025' ELSE '2026' END AS period, c_custkey % 5 = 0 AS ood FROM customer), f AS (SELECT o_custkey AS k, c_mktsegment || ' ' || (o_orderkey % 3 + c_nationkey) AS t FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT k, 'lost' AS problem FROM n WHERE NOT EXISTS (FROM f WHERE f.k = n.k AND contains(lower(t), lower(replace(anchor, '  ', ' ')))) UNION ALL SELECT k, 'period' FROM n WHERE period <> '2026' UNION ALL SELECT k, 'out of date' FROM n WHERE ood <> (k % 6 = 0)""")  # fmt: skip
def qlt07_notes_check(spark, sf):
    c = views._t(spark, sf, "customer")
    notes = c.select(F.col("c_custkey").alias("k"), F.concat(F.lower("c_mktsegment"), F.lit("  "), F.col("c_nationkey")).alias("anchor"), F.when(F.col("c_custkey") % 7 == 0, "2025").otherwise("2026").alias("period"), (F.col("c_custkey") % 5 == 0).alias("out_of_date"))
    owned = views._t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey").join(c, "c_custkey")
    footnotes = owned.select(F.col("c_custkey").alias("k"), F.concat("c_mktsegment", F.lit(" "), F.col("o_orderkey") % 3 + F.col("c_nationkey")).alias("text"))
    return boards.notes_check(notes, footnotes, c.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 6 == 0).alias("out_of_date")), "k", "2026")

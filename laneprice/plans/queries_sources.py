"""Queries for readers, writers and streams over files made from the given tables, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.durable import shared_dir
from ..sources import documents, sheets, sinks
from ..streaming import prices
from ..operators.durable import cut
from . import views
from .registered import query


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(" SELECT series, period, mills / 1000.0::DOUBLE AS price FROM v_weekly")
def src01_read_weekly(spark, sf):
    values = F.map_from_entries(F.collect_list(F.struct("series", (F.col("mills") / 1000).alias("price"))))
    docs = views.weekly(spark, sf).groupBy("period").agg(values.alias("values")).groupBy(F.year("period").alias("y")).agg(F.collect_list(F.struct("period", "values")).alias("weeks"))
    path = _path(spark, "weekly")
    docs.select(F.lit("weekly/1").alias("schema"), "weeks").write.option("ignoreNullFields", False).json(path)
    return documents.read_weekly(spark, path, "weekly/1")


@query(", c AS (SELECT series, CASE WHEN month(period) = 3 AND day(period) < 8 THEN period + 1 ELSE period END AS period, mills FROM v_weekly WHERE period >= DATE '1996-01-01') SELECT series, period, mills, CASE WHEN isodow(period) <> 1 THEN 'not a Monday' WHEN mills NOT BETWEEN 1500 AND 3000 THEN 'out of range' END AS reject FROM c WHERE period IN (SELECT period FROM c WHERE mills IS NOT NULL)")
def src02_weekly_grid(spark, sf):
    moved = F.when((F.month("period") == 3) & (F.day("period") < 8), F.date_add("period", 1)).otherwise(F.col("period"))
    cells = views.weekly(spark, sf).where("period >= DATE '1996-01-01'").select("series", moved.alias("period"), F.coalesce((F.col("mills") / 1000).cast("string"), F.lit(" ")).alias("price"))
    return documents.normalize_weekly_grid(cells, "1996-01-01", 1500, 3000)


@query(", last AS (SELECT max(period) AS last FROM (SELECT period FROM v_weekly WHERE mills IS NOT NULL GROUP BY 1 HAVING count(*) = 5)), d AS (SELECT DISTINCT period FROM v_weekly, last WHERE period <= last ORDER BY 1 DESC LIMIT 20), r AS (SELECT * FROM v_weekly JOIN d USING (period) WHERE mills IS NOT NULL) SELECT series, period, mills FROM r WHERE period IN (SELECT period FROM r GROUP BY 1 HAVING count(*) = 5)")
def src03_regional_feed(spark, sf):
    w = cut(views.weekly(spark, sf))
    # Up to the last whole week: the newest date must be whole, older ones that aren't are passed over.
    last = w.where("mills IS NOT NULL").groupBy("period").agg(F.count("*").alias("n")).where("n = 5").agg(F.max("period").alias("last"))
    feed = w.join(F.broadcast(last), F.col("period") <= F.col("last")).select("period", F.concat(F.lit(" region "), "series").alias("region"), F.coalesce((F.col("mills") / 1000).cast("string"), F.lit("")).alias("price"))
    names = views._t(spark, sf, "region").select(F.concat(F.lit("region R"), "r_regionkey").alias("region"), F.concat(F.lit("R"), "r_regionkey").alias("series"))
    return documents.regional_feed(feed, names, 5, 20)


@query(r''', l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l GROUP BY 1, 2''')
def src04_page_links(spark, sf):
    return documents.extract_links(views._t(spark, sf, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(" SELECT event_id, CASE WHEN event_id % 5 = 1 OR contains(props, '7') THEN 'blocked' WHEN event_id % 5 = 2 THEN 'error' ELSE 'ok' END AS outcome FROM events")
def src06_classify_fetches(spark, sf):
    e = views._t(spark, sf, "events")
    status = F.when(F.col("event_id") % 5 == 1, 403).when(F.col("event_id") % 5 == 2, 500).otherwise(200)
    rows = e.select("event_id", status.alias("status"), F.lit(None).cast("string").alias("mitigated"), F.col("props").alias("body"))
    return documents.classify_fetches(rows, ["7"]).select("event_id", "outcome")


@query(" SELECT as_of, code::VARCHAR AS code, units::DOUBLE AS value FROM v_daily WHERE as_of IN (SELECT DISTINCT as_of FROM v_daily ORDER BY 1 DESC LIMIT 10)")
def src07_read_snapshots(spark, sf):
    values = F.map_from_entries(F.collect_list(F.struct(F.col("code").cast("string"), F.col("units").cast("double").alias("v"))))
    path = _path(spark, "snapshots")
    views.daily(spark, sf).groupBy("as_of").agg(values.alias("values")).withColumn("day", F.col("as_of").cast("string")).repartition("day").write.partitionBy("day").json(path)
    return documents.read_snapshots(spark, path, 10)


@query(", r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 1 THEN p_size / 100.0::DOUBLE ELSE p_size::DOUBLE END AS rate, p_partkey % 8 >= 4 AS dated FROM part), m AS (SELECT *, CASE WHEN rate = 0 AND NOT dated THEN NULL ELSE floor((CASE WHEN rate < 1.5 THEN rate * 100 ELSE rate END) * 1000 + 0.5)::BIGINT END AS mils FROM r) SELECT p_partkey, mils, CASE WHEN rate < 0 THEN 'negative' WHEN rate = 0 AND dated THEN 'zero with a date' WHEN mils NOT BETWEEN 5000 AND 45000 THEN 'out of band' END AS reject FROM m")
def src09_normalize_tax(spark, sf):
    k = F.col("p_partkey")
    rate = F.when(k % 4 == 0, 0.0).when(k % 4 == 1, F.col("p_size") / 100).otherwise(F.col("p_size").cast("double"))
    rows = views._t(spark, sf, "part").select("p_partkey", rate.alias("rate"), F.when(k % 8 >= 4, F.lit("2020-01-01").cast("date")).alias("effective"))
    return documents.normalize_tax(rows, 5000, 45000).select("p_partkey", "mils", "reject")


_TAXED = """, c AS (SELECT c_custkey AS k, c_custkey // 60 AS sheet, c_custkey % 60 AS i FROM customer), r AS (
  SELECT *, CASE WHEN i < 50 THEN 'S' || i WHEN i = 50 THEN 'Federal Tax' WHEN i = 51 THEN 'Puerto Rico' WHEN i = 52 THEN 'DC' WHEN i = 53 AND sheet % 3 = 0 THEN 'Atlantis' WHEN i = 54 AND sheet % 4 = 1 THEN 'S7' ELSE '' END AS name,
    CASE WHEN i = 50 THEN '24.4' WHEN k % 7 = 0 THEN '0' WHEN k % 11 = 0 THEN '0.' || (10 + k % 50) WHEN k % 13 = 0 THEN 'n/a' WHEN k % 17 = 0 THEN '-4' WHEN k % 29 = 0 THEN '' ELSE (2 + k % 60) || '.00' || (k % 10) || '5' END AS rate,
    CASE WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN '-' ELSE '1/5/2020' END WHEN k % 19 = 0 THEN 'soon' WHEN k % 23 = 0 THEN '12/31/2025' WHEN k % 3 = 0 THEN (1 + k % 12) || '/' || (1 + k % 28) || '/' || (10 + k % 16) ELSE (1 + k % 12) || '/' || (1 + k % 28) || '/' || (90 + k % 10) END AS date FROM c)"""


@query(_TAXED + """, n AS (SELECT *, CASE WHEN i < 50 THEN i WHEN i = 52 THEN 50 WHEN i = 54 AND name <> '' THEN 7 END AS code, TRY_CAST(rate AS DECIMAL(20, 8)) AS v FROM r WHERE name <> '' AND i <> 51),
m AS (SELECT *, CASE WHEN v < 1.5 AND i <> 50 THEN v * 100 ELSE v END AS cents, v = 0 AND date = '-' AND i <> 50 AS none,
  CASE WHEN date IN ('-', 'soon') THEN NULL WHEN length(string_split(date, '/')[3]) = 4 THEN strptime(date, '%-m/%-d/%Y')::DATE WHEN string_split(date, '/')[3]::INT > 25 THEN make_date(1900 + string_split(date, '/')[3]::INT, string_split(date, '/')[1]::INT, string_split(date, '/')[2]::INT) ELSE make_date(2000 + string_split(date, '/')[3]::INT, string_split(date, '/')[1]::INT, string_split(date, '/')[2]::INT) END AS eff FROM n),
j AS (SELECT *, floor(cents * 1000 + 0.5)::BIGINT AS mils, CASE WHEN i = 54 AND EXISTS (SELECT 1 FROM n x WHERE x.sheet = m.sheet AND x.i = 7) THEN 'twice' WHEN code IS NULL AND i <> 50 THEN 'unknown state' WHEN rate = '' THEN 'empty rate' WHEN v IS NULL THEN 'not a number' WHEN v < 0 AND i <> 50 THEN 'negative'
  WHEN v = 0 AND NOT none AND i <> 50 THEN 'zero with a date' WHEN NOT none AND i <> 50 AND eff IS NULL THEN 'not a date' WHEN NOT none AND i <> 50 AND eff > DATE '2025-10-16' THEN 'after the table was made' WHEN NOT none AND floor(cents * 1000 + 0.5) NOT BETWEEN 5000 AND 100000 THEN 'out of band' END AS reason FROM m),
s AS (SELECT DISTINCT sheet FROM c)
SELECT sheet, CASE WHEN reason IS NOT NULL THEN 'reject' WHEN i = 50 THEN 'federal' ELSE 'rate' END AS kind, CASE WHEN reason IS NOT NULL THEN CASE WHEN i = 52 THEN 'District of Columbia' ELSE name END WHEN i <> 50 THEN code::VARCHAR END AS name, CASE WHEN reason IS NULL AND NOT none THEN mils END AS mils, CASE WHEN reason IS NULL AND NOT none AND i <> 50 THEN eff END AS effective, reason FROM j
UNION ALL SELECT sheet, 'reject', q.code::VARCHAR, NULL, NULL, 'missing state' FROM s, range(51) q(code) WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.sheet = s.sheet AND j.code = q.code)
UNION ALL SELECT sheet, 'reject', NULL, NULL, NULL, 'no federal row' FROM s WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.sheet = s.sheet AND j.i = 50 AND reason IS NULL)""")
def src09_import_taxes(spark, sf):
    """Sheets of 60 rows made of customers, their columns in an order of their own, below a title and a header row."""
    made = views._t(spark, sf, "customer").selectExpr("c_custkey AS k", "c_custkey div 60 AS sheet", "c_custkey % 60 AS i")
    name = "CASE WHEN i < 50 THEN concat('S', i) WHEN i = 50 THEN 'Federal Tax' WHEN i = 51 THEN 'Puerto Rico' WHEN i = 52 THEN 'DC' WHEN i = 53 AND sheet % 3 = 0 THEN 'Atlantis' WHEN i = 54 AND sheet % 4 = 1 THEN 'S7' ELSE '' END AS name"
    rate = "CASE WHEN i = 50 THEN '24.4' WHEN k % 7 = 0 THEN '0' WHEN k % 11 = 0 THEN concat('0.', 10 + k % 50) WHEN k % 13 = 0 THEN 'n/a' WHEN k % 17 = 0 THEN '-4' WHEN k % 29 = 0 THEN '' ELSE concat(2 + k % 60, '.00', k % 10, '5') END AS rate"
    date = "CASE WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN '-' ELSE '1/5/2020' END WHEN k % 19 = 0 THEN 'soon' WHEN k % 23 = 0 THEN '12/31/2025' WHEN k % 3 = 0 THEN concat_ws('/', 1 + k % 12, 1 + k % 28, 10 + k % 16) ELSE concat_ws('/', 1 + k % 12, 1 + k % 28, 90 + k % 10) END AS date"
    places = {"name": F.col("sheet") % 3, "rate": (F.col("sheet") + 1) % 3, "date": (F.col("sheet") + 2) % 3}
    cell = lambda row, col, text: F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"), text.alias("text"))
    rows = made.selectExpr("k", "sheet", "i", name, rate, date)
    body = rows.select("sheet", F.explode(F.array(*(cell(F.col("i") + 5, at, F.col(c)) for c, at in places.items()))).alias("c"))
    top = [cell(F.lit(4), at, F.lit(sheets.TAX_LABELS[c])) for c, at in places.items()] + [cell(F.lit(y), F.lit(x), F.lit(t)) for y, x, t in ((0, 0, "Title"), (1, 4, "CurrDate"), (2, 4, "10/16/2025"), (1, 5, "CurrYear"), (2, 5, "2025"))]
    cells = body.unionByName(made.select("sheet").distinct().select("sheet", F.explode(F.array(*top)).alias("c"))).select("sheet", "c.*")
    states = spark.range(51).select(F.when(F.col("id") < 50, F.concat(F.lit("S"), "id")).otherwise("District of Columbia").alias("name"), F.col("id").alias("code"))
    found = sheets.import_taxes(cells, states)
    none = lambda kind: F.lit(None).cast(kind)
    rates = found.rates.select("sheet", F.lit("rate").alias("kind"), F.col("code").cast("string").alias("name"), "mils", "effective", none("string").alias("reason"))
    federal = found.federal.select("sheet", F.lit("federal").alias("kind"), none("string").alias("name"), "mils", none("date").alias("effective"), none("string").alias("reason"))
    rejects = found.rejects.select("sheet", F.lit("reject").alias("kind"), "name", none("long").alias("mils"), none("date").alias("effective"), "reason")
    return rates.unionByName(federal).unionByName(rejects)


@query(", c AS (SELECT c_custkey // 10 AS sheet, c_custkey % 10 AS i, c_name FROM customer) SELECT sheet, max(CASE WHEN i = 4 THEN c_name END) AS value FROM c GROUP BY sheet")
def src20_value_below(spark, sf):
    """Columns of ten customers, one of them a label."""
    k = F.col("c_custkey")
    cells = views._t(spark, sf, "customer").select(F.expr("c_custkey div 10").alias("sheet"), (k % 10).alias("row"), F.lit(2).alias("col"), F.when(k % 10 == 3, " CurrYear ").otherwise(F.col("c_name")).alias("text"))
    return sheets.value_below(cells, "CurrYear", required=False)


@query(", r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, sum(CASE WHEN l_linenumber % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2)) SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber) AS text FROM r GROUP BY l_orderkey, run")
def src10_fold_lines(spark, sf):
    rows = views._t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").cast("string").alias("text"))
    rows = rows.withColumn("name", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_linenumber").cast("string")).otherwise(""))
    return documents.fold_continuation_lines(rows, ["l_orderkey"], "l_linenumber", "name", "text").select("l_orderkey", "text")


@query(" SELECT id, round(lat, 5) AS lat, round(lon, 5) AS lon FROM v_point WHERE id % 3 < 2")
def src13_flatten_points(spark, sf):
    p, k = views.points(spark, sf), F.col("id") % 3
    props = F.when(k == 1, F.create_map(F.lit("Lat"), F.col("lat").cast("string"), F.lit("lon"), F.col("lon").cast("string"))).otherwise(F.create_map(F.lit("Lat"), F.lit("n/a")))
    rows = p.select("id", F.when(k == 0, F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("geometry"), props.alias("props"))
    return documents.flatten_points(rows).select("id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query(", c AS (SELECT l_orderkey AS sheet, l_linenumber AS row, l_partkey AS col, l_returnflag AS text FROM (SELECT DISTINCT l_orderkey, 1 AS l_linenumber, l_partkey, l_returnflag FROM lineitem)), m AS (SELECT * FROM c WHERE text = 'R') SELECT m.sheet, m.row, min(c.col) IS NOT NULL AS found FROM m LEFT JOIN c ON c.sheet = m.sheet AND c.row = m.row AND c.col > m.col GROUP BY m.sheet, m.row, m.col")
def src20_label_values(spark, sf):
    cells = views._t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.lit(1).alias("row"), F.col("l_partkey").alias("col"), F.col("l_returnflag").alias("text")).distinct()
    return documents.label_values(cells, "r").select("sheet", "row", F.col("value").isNotNull().alias("found"))


@query(" SELECT l_returnflag AS service, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1")
def src19_whole_pages(spark, sf):
    rows = views._t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("service"), "l_orderkey")
    told = rows.groupBy("service").agg((F.count("*") + F.when(F.col("service") == "A", 1).otherwise(0)).alias("n"))
    return documents.whole_pages(rows, told).groupBy("service").agg(F.count("*").alias("n"))


@query(" SELECT series, period, mills FROM v_weekly")
def snk02_write_if_changed(spark, sf):
    w, path = views.weekly(spark, sf), _path(spark, "weekly")
    if not sinks.write_if_changed(w, path) or sinks.write_if_changed(w, path):
        raise AssertionError("written twice or never")
    return spark.read.parquet(path)


@query(" SELECT code, mils, CASE WHEN code % 3 = 0 THEN 'new' ELSE 'old' END AS stamp FROM v_tax")
def snk03_keep_stamp(spark, sf):
    t = views.taxes(spark, sf).select("code", "mils")
    old = t.withColumn("mils", F.when(F.col("code") % 3 == 0, F.coalesce("mils", F.lit(0)) + 1).otherwise(F.col("mils"))).withColumn("stamp", F.lit("old"))
    return sinks.keep_stamp(t.withColumn("stamp", F.lit("new")), old, "code", "stamp")


@query(" SELECT code, max(as_of) AS as_of, arg_max(units, as_of) AS units FROM v_daily GROUP BY 1")
def str01_upsert_stream(spark, sf):
    arrived, target = _path(spark, "arrived"), _path(spark, "target")
    d = views.daily(spark, sf)
    d.repartition(4, "as_of").write.parquet(arrived)
    source = prices.read_arrivals(spark, arrived, d.schema, 2)
    prices.upsert_stream(source, target, ["code"], "as_of", _path(spark, "stream")).awaitTermination()
    return spark.read.parquet(target).drop("bucket")


@query(" , r AS (SELECT *, lag(units) OVER (PARTITION BY code ORDER BY as_of) AS prev, row_number() OVER (PARTITION BY code ORDER BY as_of DESC) AS k FROM v_daily) SELECT code, as_of, units, prev, units - prev AS change FROM r WHERE k = 1")
def str02_move_stream(spark, sf):
    arrived, out = _path(spark, "arrived"), _path(spark, "moves")
    d = views.daily(spark, sf)
    d.repartition(4, "as_of").write.parquet(arrived)
    prices.move_stream(prices.read_arrivals(spark, arrived, d.schema, 2), _path(spark, "state"), out, "code", "as_of", "units", _path(spark, "stream")).awaitTermination()
    return spark.read.parquet(out).drop("pct", "gap", "flags", "bucket")


@query(" SELECT event_type, ts::DATE AS day, count(*) AS n, max(ts)::TIMESTAMP AS newest FROM events GROUP BY 1, 2")
def str03_freshness_stream(spark, sf):
    arrived, out = _path(spark, "arrived"), _path(spark, "fresh")
    e = views._t(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.repartition(2).write.parquet(arrived)
    fresh = prices.freshness_stream(prices.read_arrivals(spark, arrived, e.schema), "event_type", "ts")
    stream = fresh.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.select("event_type", F.to_date("window.start").alias("day"), "n", F.col("newest").cast("timestamp_ntz").alias("newest")).write.mode("overwrite").parquet(out))
    stream.option("checkpointLocation", _path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(" SELECT page_id, DATE '2026-01-05' AS as_of, c AS code, 3 + page_id % 9 / 10.0::DOUBLE AS price, NULL AS reject FROM pages, (VALUES ('OH'), ('TX')) v(c) WHERE page_id % 7 = 0 UNION ALL SELECT page_id, NULL, NULL, NULL, ['state twice', 'no single date', 'no rows', 'no such column', 'bad row', 'no table'][page_id % 7] FROM pages WHERE page_id % 7 > 0")
def src04_state_prices(spark, sf):
    """Tables whose diesel column stands between two others, and tables that break a rule."""
    k = F.col("page_id") % 7
    price = F.format_string("$3.%d00", F.col("page_id") % 9)
    row = lambda code: F.concat(F.lit(f'<tr><td><a href="/x?state={code}">x</a></td><td>$9.99</td><td class="diesel"> '), price, F.lit(" </td><td>$8.88</td></tr>"))
    rows = F.when(k == 3, "").when(k == 1, F.concat(row("OH"), row("OH"))).when(k == 5, F.concat(row("OH"), F.regexp_replace(row("TX"), r" [$]3[.]", " 3."))).otherwise(F.concat(row("OH"), row("TX")))
    day = F.when(k == 2, "").otherwise("Price as of 1/5/26")
    head = F.concat(F.lit("<thead><tr><th>State</th><th>Regular</th><th><b>"), F.when(k == 4, "E85").otherwise("Diesel"), F.lit("</b></th><th>Other</th></tr></thead><tbody>"))
    made = views._t(spark, sf, "pages").select("page_id", F.concat(F.col("html"), day, F.when(k == 6, "<table>").otherwise('<table class="x" id="sortable">'), head, rows, F.lit("</tbody></table>")).alias("html"))
    return documents.extract_state_prices(made).withColumn("price", F.col("price").cast("double"))


@query(" SELECT s_suppkey AS id, path, CASE WHEN s_suppkey % 4 > 0 THEN 'I' || s_suppkey END AS sign, (s_suppkey % 3)::INTEGER AS code, CASE WHEN s_suppkey % 5 > 0 THEN 'North Land' END AS state, 2 + path AS n FROM supplier, (VALUES (0), (2)) v(path) WHERE s_suppkey % 3 < 2")
def src14_line_features(spark, sf):
    k = F.col("s_suppkey")
    at = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    paths = F.array(F.array(at, at), F.array(at), F.array(at, at, at, at))
    rows = views._t(spark, sf, "supplier").select(k.alias("id"), F.when(k % 4 > 0, F.concat(F.lit(" I\t"), k.cast("string"))).otherwise(" \n").alias("sign"), (k % 3).cast("int").alias("code"), F.when(k % 5 > 0, F.lit(" North   Land ")).otherwise("").alias("state"), paths.alias("paths"))
    return documents.flatten_lines(rows, [0, 1]).select("id", "path", "sign", "code", "state", F.size("points").alias("n"))


@query(" SELECT s_suppkey // 2 AS ring, (CASE WHEN count(*) = 2 THEN 5 ELSE 3 END)::INTEGER AS n, max(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 0.5::DOUBLE END) AS x0, max(CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey * 0.5::DOUBLE ELSE (s_suppkey + 2) * 0.5::DOUBLE END) FILTER (s_suppkey % 2 = 1 OR s_suppkey = (SELECT max(s_suppkey) FROM supplier)) AS x1 FROM supplier GROUP BY 1")
def src16_shared_arcs(spark, sf):
    k = F.col("s_suppkey")
    step = lambda x, y: F.struct(F.lit(x).cast("long").alias("dx") if isinstance(x, int) else x.alias("dx"), F.lit(y).cast("long").alias("dy"))
    rows = views._t(spark, sf, "supplier")
    arcs = rows.select(k.alias("arc"), F.array(step(k, 0), step(1, 3), step(1, -3)).alias("deltas"))
    refs = rows.select(F.expr("s_suppkey div 2").alias("ring"), (k % 2).cast("int").alias("n"), k.alias("arc"), (k % 2 == 1).alias("reversed"))
    got = documents.assemble_arcs(arcs, refs, 0.5)
    return got.select("ring", F.size("points").alias("n"), F.element_at("points", 1)["x"].alias("x0"), F.element_at("points", -1)["x"].alias("x1"))


@query(" SELECT c_custkey AS id, c_name AS name, c_custkey % 90 + 0.5::DOUBLE AS lat, -(c_custkey % 180) - 0.25::DOUBLE AS lon, (c_custkey * 3)::BIGINT AS population, DATE '2026-01-01' AS modified FROM customer")
def src17_gazetteer(spark, sf):
    k, path = F.col("c_custkey"), _path(spark, "gazetteer")
    own = {"id": k, "name": F.col("c_name"), "lat": k % 90 + 0.5, "lon": -(k % 180) - 0.25, "population": k * 3, "modified": F.lit("2026-01-01")}
    columns = [x.split()[0] for x in documents.GAZETTEER.split(", ")]
    views._t(spark, sf, "customer").select(*(own.get(c, F.lit(f'a "{c}"')).cast("string").alias(c) for c in columns)).write.csv(path, sep="\t", quote="")
    return documents.read_gazetteer(spark, path).select("id", "name", "lat", "lon", "population", "modified")


@query(" SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 90 + 0.5::DOUBLE END AS lat FROM customer")
def src18_point_list(spark, sf):
    k, path = F.col("c_custkey"), _path(spark, "pins")
    own = {"ID": k.cast("string"), "Name": F.col("c_name"), "Latitude": F.when(k % 3 == 0, F.element_at(F.array(F.lit("north"), F.lit("NaN")), (k % 2 + 1).cast("int"))).otherwise((k % 90 + 0.5).cast("string"))}
    views._t(spark, sf, "customer").select(*(own.get(c, F.lit("1")).alias(c) for c in documents.POINT_LIST)).write.option("header", True).csv(path)
    return documents.read_point_list(spark, path).select(F.col("ID").alias("id"), F.col("Name").alias("name"), F.col("Latitude").alias("lat"))


@query(" SELECT 'weekly' AS part, count(*) AS n FROM v_weekly UNION ALL SELECT 'tax', count(*) FROM v_tax")
def snk01_write_validated(spark, sf):
    weekly, tax = _path(spark, "weekly"), _path(spark, "tax")
    w, t = views.weekly(spark, sf), views.taxes(spark, sf)
    good = {weekly: (w, {"price": F.col("mills").isNull() | (F.col("mills") > 0)}), tax: (t, {"rate": F.coalesce(F.col("mils") > 0, F.lit(True))})}
    try:
        sinks.write_validated({weekly: (w, {"period": F.col("period").isNotNull()}), tax: (t, {"rate": F.col("mils") < 0})})
    except ValueError:
        pass
    if sinks.exists(spark, weekly) or sinks.exists(spark, tax):
        raise AssertionError("written in spite of a breach")
    sinks.write_validated(good)
    count = lambda part, path: spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count("weekly", weekly).unionByName(count("tax", tax))


@query(" SELECT o_orderkey AS \"row\", 'reason ' || o_orderkey % 3 AS reason, o_orderpriority AS name FROM orders WHERE o_orderkey % 3 > 0 OR o_orderstatus = 'F'")
def snk04_write_rejects(spark, sf):
    path, k = _path(spark, "rejects"), F.col("o_orderkey")
    rows = views._t(spark, sf, "orders").where((k % 3 > 0) | (F.col("o_orderstatus") == "F"))
    sinks.write_rejects(rows.select(k.alias("row"), F.concat(F.lit("reason "), (k % 3).cast("string")).alias("reason"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("address")), path)
    return spark.read.option("header", True).csv(path).select(F.col("row").cast("long").alias("row"), "reason", "name")

"""Queries for names, words, dates and small values, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, money, text
from . import views
from .registered import query


def _case(rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(n, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in rules)


_N = r"n AS (SELECT id, lower(trim(regexp_replace(replace(coalesce(name, ''), '’', ''''), '\s+', ' ', 'g'))) AS n FROM v_pin)"
_KIND = f"{_case(text.CATEGORIES[:3])} WHEN regexp_matches(n, 'scale') AND NOT regexp_matches(n, 'tire|tyre') THEN 'weigh' ELSE {_case(text.CATEGORIES[3:])} END END"
_PIN = f"{_N}, c AS (SELECT id, n, {_case(text.REFUSED)} END AS refused, {_KIND} AS found FROM n), k AS (SELECT id, n, CASE WHEN refused IS NULL THEN found END AS category, CASE WHEN refused IS NOT NULL THEN refused WHEN found IS NULL THEN {_case(text.DROPPED)} ELSE 'no rule matched' END END AS reason FROM c)"


def _pins(spark, sf):
    p = views.pins(spark, sf).withColumn("n", text.normalize_name(F.col("name")))
    return p.select("id", "n", text.category(F.col("n")).alias("category"), text.drop_reason(F.col("n")).alias("reason"))


@query(f", {_PIN} SELECT id, category, reason FROM k")
def cls03_categorize_pins(spark, sf):
    return _pins(spark, sf).drop("n")


@query(rf", {_N}, d AS (SELECT id, unnest(regexp_extract_all(n, '\b(?:[ewns]b|(?:east|west|north|south)bound)\b')) AS w, generate_subscripts(regexp_extract_all(n, '\b(?:[ewns]b|(?:east|west|north|south)bound)\b'), 1) AS o FROM n), u AS (SELECT id, upper(w[1]) || 'B' AS d, min(o) AS o FROM d GROUP BY 1, 2) SELECT n.id, coalesce(string_agg(d, ',' ORDER BY o), '') AS directions FROM n LEFT JOIN u USING (id) GROUP BY 1")
def cls04_directions(spark, sf):
    return _pins(spark, sf).select("id", F.array_join(text.directions(F.col("n")), ",").alias("directions"))


@query(r", h AS (SELECT id, list_distinct([x FOR x IN regexp_extract_all(coalesce(name, ''), '\b([A-Z]{2}) \d{5}\b', 1) IF x IN ('UT', 'TX')]) AS h FROM v_pin) SELECT id, array_to_string(h, ',') AS hints FROM h WHERE len(h) > 0")
def cls05_state_hints(spark, sf):
    hints = text.state_hints(F.col("name"), F.array(F.lit("UT"), F.lit("TX")))
    return views.pins(spark, sf).select("id", hints.alias("h")).where(F.size("h") > 0).select("id", F.array_join("h", ",").alias("hints"))


@query(" SELECT count(*) AS visible, count(*) FILTER (id % 4 = 0) AS flagged FROM v_point WHERE lat BETWEEN 30 AND 40 AND lon BETWEEN -110 AND -90 AND brand NOT IN ('Brand#11', 'Brand#22')")
def cls09_visible(spark, sf):
    from ..operators.spatial import in_box

    shown = views.points(spark, sf).where(in_box(F.col("lat"), F.col("lon"), -110, 30, -90, 40) & ~F.col("brand").isin("Brand#11", "Brand#22"))
    return shown.agg(F.count("*").alias("visible"), F.count_if(F.col("id") % 4 == 0).alias("flagged"))


@query(", m AS (SELECT code, name FROM v_state WHERE starts_with(lower(code::VARCHAR), 'na') OR contains(lower(name), 'na')) SELECT code, name, lower(name) = 'na' OR count(*) OVER () = 1 AS hit FROM m")
def cls10_find_states(spark, sf):
    from ..operators.relations import find_rows

    return find_rows(views.states(spark, sf).select("code", "name"), "code", "name", "na")


@query(f", {_PIN} SELECT category, count(*) AS n, CASE category {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v.replace(chr(39), chr(39) * 2)}{chr(39)}' for k, v in text.LABELS.items())} END || ', northbound' AS label FROM k WHERE category IS NOT NULL GROUP BY 1")
def cls11_labels(spark, sf):
    found = _pins(spark, sf).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    return found.withColumn("label", text.label_for(F.col("category"), F.lit("NB")))


@query(f", {_PIN} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM k GROUP BY 1")
def agg03_drop_reasons(spark, sf):
    return _pins(spark, sf).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_SIZE = "CASE WHEN abs(c) >= 1000 THEN '$' || (abs(c) // 1000) || '.' || lpad((abs(c) % 1000)::VARCHAR, 3, '0') ELSE (abs(c) // 10) || '.' || (abs(c) % 10) || '¢' END"


@query(f", m AS (SELECT series, period, 5 * (mills - lag(mills) OVER (PARTITION BY series ORDER BY period)) AS c FROM v_weekly) SELECT series, period, CASE WHEN c = 0 THEN 'No change' ELSE CASE WHEN c > 0 THEN 'Up ' ELSE 'Down ' END || {_SIZE} END AS words, CASE WHEN c = 0 THEN 'Same price' ELSE {_SIZE} || CASE WHEN c < 0 THEN ' less' ELSE ' more' END END AS diff, CASE WHEN c = 0 THEN 'held steady' ELSE CASE WHEN c > 0 THEN 'rose ' ELSE 'fell ' END || (abs(c) // 10) || '.' || (abs(c) % 10) || '¢' END AS verb FROM m WHERE c IS NOT NULL")
def scl04_change_words(spark, sf):
    from ..operators import series

    c = F.col("change") * 5
    m = series.moves(views.weekly(spark, sf), ["series"], "period", F.col("mills"), 0).where("change IS NOT NULL")
    return m.select("series", "period", money.change_words(c).alias("words"), money.diff_words(c).alias("diff"), money.change_verb(c).alias("verb"))


@query(r" SELECT code, (mils // 1000) || '.' || CASE WHEN mils % 1000 = 0 THEN '0' ELSE regexp_replace(lpad((mils % 1000)::VARCHAR, 3, '0'), '0+$', '') END || '¢' AS tax FROM v_tax")
def scl05_tax_text(spark, sf):
    return views.taxes(spark, sf).select("code", money.tax_text(F.col("mils")).alias("tax"))


_HOLIDAYS = """, y AS (SELECT unnest(generate_series(1991, 2003)) AS y), f AS (SELECT make_date(y, m, d) AS d FROM y, (VALUES (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) v(m, d)),
o AS (SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END AS d FROM f),
w AS (SELECT make_date(y, m, 1) + ((wd - isodow(make_date(y, m, 1)) + 7) % 7)::INTEGER + (7 * (n - 1))::INTEGER AS d FROM y, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) v(m, wd, n)),
l AS (SELECT make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INTEGER AS d FROM y), h AS (SELECT d FROM o UNION SELECT d FROM w UNION SELECT d FROM l)"""


@query(_HOLIDAYS + """, p AS (SELECT DISTINCT period FROM v_weekly), s AS (SELECT period, period + 7 + CASE WHEN period + 7 IN (SELECT d FROM h) THEN 2 ELSE 1 END AS f FROM p),
c AS (SELECT period, f + k::INTEGER AS d FROM s, range(10) r(k)) SELECT period, min(d)::DATE AS expected FROM (SELECT period, d::DATE AS d FROM c) WHERE isodow(d) < 6 AND d NOT IN (SELECT d FROM h) GROUP BY 1""")
def scl08_expected_release(spark, sf):
    return calendar.expected_release(views.weekly(spark, sf).select("period").distinct(), "period")


@query(" SELECT o_orderkey, CASE WHEN o_orderdate::DATE + 8 <= o_orderdate::DATE + (o_orderkey % 14)::INTEGER THEN o_orderdate::DATE + (o_orderkey % 14)::INTEGER ELSE o_orderdate::DATE + 8 END AS date, CASE WHEN 8 <= o_orderkey % 14 THEN o_orderdate::DATE + (o_orderkey % 14)::INTEGER ELSE o_orderdate::DATE + 8 END < DATE '1998-01-01' AS late FROM orders")
def scl09_next_release(spark, sf):
    d = views._t(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    found = calendar.next_release(F.col("d"), F.date_add("d", 8), F.date_add("d", (F.col("o_orderkey") % 14).cast("int")), F.lit("1998-01-01").cast("date"))
    return d.select("o_orderkey", found.alias("r")).select("o_orderkey", "r.*")


@query(r", f AS (SELECT id, trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(name), '[.''’‘ʼʻ]', '', 'g'), '-', ' '), '\s*,\s*', ', ', 'g'), '\s+', ' ', 'g')) AS t FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'Saint ' ELSE 'Fort-Mount , ' END || name AS name FROM v_pin)) SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, ',$', ''), '\bsaint\b', 'st', 'g'), '\bfort\b', 'ft', 'g'), '\bmount\b', 'mt', 'g') AS folded FROM f")
def scl11_fold(spark, sf):
    name = F.concat(F.when(F.col("id") % 3 == 0, "Saint ").otherwise("Fort-Mount , "), "name")
    return views.pins(spark, sf).select("id", text.fold(name).alias("folded"))


@query(r", t AS (SELECT o_orderkey, ' ' || replace(round(o_totalprice / 10000, 3)::VARCHAR, '.', CASE WHEN o_orderkey % 2 = 0 THEN ',' ELSE '.' END) || CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END AS t FROM orders), c AS (SELECT o_orderkey, replace(trim(t), ',', '.') AS t FROM t), n AS (SELECT o_orderkey, CASE WHEN regexp_matches(t, '^\d+(\.\d*)?$|^\.\d+$') THEN TRY_CAST(t AS DOUBLE) END AS n FROM c) SELECT o_orderkey, CASE WHEN n BETWEEN 0 AND 10 THEN n END AS base, CASE WHEN n BETWEEN 2 AND 20 THEN n END AS mpg FROM n")
def scl13_parse_numbers(spark, sf):
    o = views._t(spark, sf, "orders")
    typed = F.concat(F.lit(" "), F.regexp_replace(F.round(F.col("o_totalprice") / 10000, 3).cast("string"), r"\.", F.when(F.col("o_orderkey") % 2 == 0, ",").otherwise(".")), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""))
    return o.select("o_orderkey", text.parse_number(typed, 0, 10, 3).alias("base"), text.parse_number(typed, 2, 20).alias("mpg"))


@query(" , t AS (SELECT o_orderkey, greatest(5, floor(o_totalprice / 60000 * 12 + 0.5)::BIGINT * 5) AS m FROM orders) SELECT o_orderkey, trim(CASE WHEN m >= 60 THEN (m // 60) || CASE WHEN m // 60 = 1 THEN ' hour' ELSE ' hours' END ELSE '' END || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || ' minutes' ELSE '' END) AS words FROM t")
def scl17_hours(spark, sf):
    return views._t(spark, sf, "orders").select("o_orderkey", money.hours_text(F.col("o_totalprice") / 60000).alias("words"))

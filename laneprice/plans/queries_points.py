"""Queries for mapped objects, borders, weigh station names, signs and typed places, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags
from ..operators import borders, places
from ..sources import elements
from . import views
from .registered import query


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


_NAMES = ["BRAZIL", "CANADA"]
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_TEXT = "(o.name || ' ' || o.operator || '  ' || CASE WHEN o.k = 'brand' THEN o.v ELSE '' END)"
_ROWS = f", t AS (SELECT id, lat, lon, o.name AS name, o.k AS k, o.v AS v, {_TEXT} AS x FROM v_object), f AS (SELECT *, k = 'service' AS station, k = 'service' OR (k = 'amenity' AND v IN {_IN(tags.WEIGH_AMENITY)}) AS tagged, {_m('x', tags.GOVERNMENT)} AS gov FROM t)"
_BORDER = _m("regexp_replace(x, '(?i)new mexico', 'n m', 'g')", tags.BORDER.replace("(?<!new )", ""))
_CLASS = f"""CASE WHEN {_m('x', tags.CAT_SCALE)} THEN 'cat_scale' WHEN k = 'barrier' OR {_BORDER} THEN 'border' WHEN {_m('x', tags.AGRICULTURAL)} THEN 'agricultural'
  WHEN {_m('x', tags.VEHICLE_INSPECTION)} AND NOT {_m('x', tags.ENFORCEMENT)} THEN 'vehicle_inspection' WHEN {_m('name', tags.CLOSED)} OR starts_with(k, 'disused') THEN 'closed'
  WHEN NOT tagged AND (k = 'highway' OR {_m('name', tags.ROAD_NAME)}) THEN 'road' WHEN k IN {_IN(tags.NOT_A_STATION_KEYS)} OR (k = 'amenity' AND v NOT IN {_IN(tags.STATION_AMENITY)}) THEN 'not_a_station'
  WHEN NOT gov AND ({_m('x', tags.PRIVATE)} OR (k = 'access' AND NOT station)) THEN 'private' WHEN k = 'amenity' AND v = 'weighbridge' AND NOT gov AND NOT {_m('name', tags.STATION_NAME)} THEN 'private_scale'
  WHEN tagged THEN 'tag' WHEN {_m('name', tags.STATION_NAME)} OR ({_m('name', tags.INSPECTION_NAME)} AND (gov OR {_m('x', tags.TRUCK_WORDS)} OR {_m('name', '(BRAZIL|CANADA)')}))
  OR ({_m('name', tags.SCALE_NAME)} AND (gov OR {_m('name', tags.HIGHWAY_WORDS)})) THEN 'name' ELSE 'weak' END"""


@query(f"{_ROWS} SELECT id, {_CLASS} AS reason FROM f")
def cls01_classify_elements(spark, sf):
    return views.objects(spark, sf).select("id", tags.classify_element(_NAMES).alias("reason"))


@query(f"{_ROWS} SELECT id, CASE WHEN k = 'brand:wikidata' THEN CASE v WHEN 'Q1872496' THEN 'loves' WHEN 'Q7835892' THEN 'ta' END WHEN k = 'brand' AND v IN ('ONE9', 'One9') THEN 'one9' WHEN {_m('x', 'ambest')} THEN 'ambest' END AS brand, gov FROM f")
def cls02_brand_of(spark, sf):
    return views.objects(spark, sf).select("id", tags.brand_of().alias("brand"), tags.is_government().alias("gov"))


def _responses(spark, sf):
    """Answers of 50 objects each; every seventh tells of an error, every eleventh has no base time."""
    o = views.objects(spark, sf)
    kind, own = F.element_at(F.array(F.lit("way"), F.lit("node"), F.lit("relation"), F.lit("area")), (F.col("id") % 4 + 1).cast("int")), F.col("id") % 3 == 0
    at = F.struct("lat", "lon")
    element = F.struct(kind.alias("type"), "id", F.when(own, F.col("lat")).alias("lat"), F.when(own, F.col("lon")).alias("lon"), F.when(F.col("id") % 3 == 1, at).alias("center"), "tags")
    rows = o.groupBy(F.expr("id div 50").alias("response")).agg(F.collect_list(element).alias("elements"))
    remark = F.when(F.col("response") % 7 == 3, "runtime error: Query timed out").when(F.col("response") % 7 == 4, "all is well")
    base = F.when(F.col("response") % 11 != 5, "2026-09-19T04:05:06Z").otherwise("2026-09-19")
    return rows.withColumn("remark", remark).withColumn("osm3s", F.struct(base.alias("timestamp_osm_base")))


@query(" SELECT id // 50 AS response, id, ['way', 'node', 'relation', 'area'][1 + id % 4] AS type, round(lat, 5) AS lat, CASE WHEN id // 50 % 7 = 3 THEN 'remark' WHEN id // 50 % 11 = 5 THEN 'no base time' WHEN id % 4 = 3 THEN 'unknown element' END AS reject FROM v_object WHERE id % 3 < 2")
def src11_tagged_elements(spark, sf):
    return elements.load_tagged_elements(_responses(spark, sf)).select("response", "id", "type", F.round("lat", 5).alias("lat"), "reject")


@query(" SELECT s_suppkey // 40 AS response, CASE WHEN s_suppkey % 13 <> 4 THEN s_suppkey END AS id, CASE WHEN s_suppkey % 3 = 0 THEN 30.5::DOUBLE ELSE 31.25::DOUBLE END AS lat, CASE WHEN s_suppkey % 5 < 2 THEN NULL ELSE 'I-80' END AS route, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 9)::INTEGER END AS spots, CASE WHEN s_suppkey // 40 % 5 = 1 THEN 'cut short' WHEN s_suppkey % 13 = 4 THEN 'no id' END AS reject FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 4 < 3")
def src12_feature_rows(spark, sf):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    name = F.element_at(F.array(*(F.lit(x) for x in ("Weigh one", "SCALE two", "NA", "Rest area"))), (k % 4 + 1).cast("int"))
    name = F.when(k % 4 == 2, F.lit("a scale")).otherwise(name)
    pairs = [("nhs_rest_stop", name), ("OBJECTID", F.when(k % 13 != 4, text(k)).otherwise("none")), ("latitude", F.when(k % 3 == 0, F.lit("30.5")).otherwise("?")), ("longitude", F.lit("-100"))]
    pairs += [("highway_route", F.when(k % 5 == 0, F.lit(" n/a ")).when(k % 5 == 1, F.lit("")).otherwise(" I-80")), ("number_of_spots", F.when(k % 2 == 0, text(k % 9)).otherwise("many"))]
    attributes = F.map_from_arrays(F.array(*(F.lit(n) for n, _ in pairs)), F.array(*(v for _, v in pairs)))
    geometry = F.when(k % 3 == 1, F.struct(F.lit(-99.5).alias("x"), F.lit(31.25).alias("y")))
    rows = views._t(spark, sf, "supplier").select(F.expr("s_suppkey div 40").alias("response"), F.struct(attributes.alias("attributes"), geometry.alias("geometry")).alias("f"))
    answers = rows.groupBy("response").agg(F.collect_list("f").alias("features")).withColumn("exceededTransferLimit", F.col("response") % 5 == 1)
    return elements.flatten_feature_rows(answers, "nhs_rest_stop").select("response", "id", "lat", "route", "spots", "reject")


@query(" SELECT page_id, DATE '2026-01-05' + (page_id % 9)::INTEGER AS as_of, 3 + page_id % 7 / 10.0::DOUBLE AS current, reject FROM (SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'header not once' WHEN 2 THEN 'row not once' WHEN 3 THEN 'no price' WHEN 4 THEN 'no single date' WHEN 5 THEN 'out of range' END AS reject FROM pages) WHERE reject IS NULL UNION ALL SELECT page_id, NULL, NULL, CASE page_id % 6 WHEN 1 THEN 'header not once' WHEN 2 THEN 'row not once' WHEN 3 THEN 'no price' WHEN 4 THEN 'no single date' ELSE 'out of range' END FROM pages WHERE page_id % 6 > 0")
def src05_national_prices(spark, sf):
    k = F.col("page_id") % 6
    head = F.when(k == 1, "<th></th><th>Diesel</th><th>Diesel</th>").otherwise("<th></th><th>Regular</th><th> Diesel </th>")
    price = F.when(k == 3, "n/a").when(k == 5, "$1.001").otherwise(F.format_string("$%d.%d00", F.lit(3), F.col("page_id") % 7))
    row = lambda label: F.concat(F.lit(f"<tr><td>{label}</td><td>$2.999</td><td>"), price, F.lit("</td></tr>"))
    now = F.concat(row("Current Avg."), F.when(k == 2, row("Current Avg.")).otherwise(""))
    day = F.concat(F.lit("<p>Price as of 1/"), (5 + F.col("page_id") % 9).cast("string"), F.lit("/26</p>"))
    made = F.concat(F.col("html"), F.lit("<table><thead><tr>"), head, F.lit("</tr></thead>"), now, row("Yesterday Avg."), F.lit("</table>"), day, F.when(k == 4, "<p>Price as of 2/1/26</p>").otherwise(""))
    got = elements.extract_national_prices(views._t(spark, sf, "pages").select("page_id", made.alias("html")))
    return got.select("page_id", "as_of", F.col("current").cast("double").alias("current"), "reject")


@query(" SELECT n_nationkey AS code, n_name AS name, 'R' || n_regionkey AS series, CASE WHEN n_nationkey = 3 THEN 'code twice' WHEN n_regionkey = 4 THEN 'unknown series' END AS reject FROM nation UNION ALL SELECT n_nationkey, n_name, 'R' || n_regionkey, CASE WHEN n_nationkey = 3 THEN 'code twice' END FROM nation WHERE n_nationkey = 3")
def src08_check_states(spark, sf):
    rows = views._t(spark, sf, "nation").selectExpr("n_nationkey AS code", "n_name AS name", "concat('R', n_regionkey) AS series")
    series = views._t(spark, sf, "region").where("r_regionkey < 4").selectExpr("concat('R', r_regionkey) AS series")
    return elements.check_states(rows.union(rows.where("code = 3")), series, 26)


def _boxes(spark, sf):
    """Rectangles of the suppliers, closed; every fifth has a hole, every seventh a ring that is too short."""
    k = F.col("s_suppkey")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    outer = F.array(at(k, k), at(k + 4, k), at(k + 4, k + 4), at(k, k + 4), at(k, k))
    hole = F.array(at(k + 1, k + 1), at(k + 2, k + 1), at(k + 2, k + 2), at(k + 1, k + 1))
    rings = F.when(k % 7 == 0, F.array(outer, F.slice(hole, 1, 2))).when(k % 5 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return views._t(spark, sf, "supplier").select(k.alias("code"), F.lit(0).alias("poly"), rings.alias("rings"))


@query(" SELECT s_suppkey AS code, is_hole, CASE WHEN is_hole THEN 3 ELSE 4 END::BIGINT AS n, CASE WHEN is_hole THEN 0.5::DOUBLE ELSE 16::DOUBLE END AS area FROM supplier, (VALUES (false), (true)) h(is_hole) WHERE s_suppkey % 7 > 0 AND (NOT is_hole OR s_suppkey % 5 = 0) UNION ALL SELECT s_suppkey, NULL, 0, 0 FROM supplier WHERE s_suppkey % 7 = 0")
def src15_boundary_edges(spark, sf):
    edges, rejects = elements.boundary_edges(_boxes(spark, sf))
    area = F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2
    found = edges.groupBy("code", "is_hole").agg(F.count("*").alias("n"), area.alias("area"))
    return found.unionByName(rejects.select("code", F.lit(None).cast("boolean").alias("is_hole"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("area")))


def _outline(spark, sf):
    from .queries_places import cell_edges

    return cell_edges(spark, sf).select("x1", "y1", "x2", "y2")


_EDGES = "e AS (SELECT lon0 AS x1, lat0 AS y1, lon0 + 11.4::DOUBLE AS x2, lat0 AS y2 FROM v_cell UNION ALL SELECT lon0 + 11.4::DOUBLE, lat0, lon0 + 11.4::DOUBLE, lat0 + 4.8::DOUBLE FROM v_cell UNION ALL SELECT lon0 + 11.4::DOUBLE, lat0 + 4.8::DOUBLE, lon0, lat0 + 4.8::DOUBLE FROM v_cell UNION ALL SELECT lon0, lat0 + 4.8::DOUBLE, lon0, lat0 FROM v_cell)"
_KM = f"""{_EDGES}, j AS (SELECT p.id, (x1 - p.lon) * cos(radians(p.lat)) * 111.32::DOUBLE AS ax, (y1 - p.lat) * 110.57::DOUBLE AS ay, (x2 - p.lon) * cos(radians(p.lat)) * 111.32::DOUBLE AS bx, (y2 - p.lat) * 110.57::DOUBLE AS "by"
  FROM v_point p JOIN e ON floor(p.lon) BETWEEN floor(least(x1, x2)) - 1 AND floor(greatest(x1, x2)) + 1 AND floor(p.lat) BETWEEN floor(least(y1, y2)) - 1 AND floor(greatest(y1, y2)) + 1),
k AS (SELECT *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * ("by" - ay)) / (pow(bx - ax, 2) + pow("by" - ay, 2)))) AS t FROM j),
d AS (SELECT id, min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * ("by" - ay), 2))) AS km FROM k GROUP BY id)"""


@query(f", {_KM} SELECT p.id, round(km, 4) AS km FROM v_point p LEFT JOIN d USING (id)")
def jon11_border_distance(spark, sf):
    found = borders.border_distance(views.points(spark, sf), _outline(spark, sf))
    return found.select("id", F.when(F.col("km") < float("inf"), F.round("km", 4)).alias("km"))


@query(f"{_ROWS}, {_KM} SELECT f.id FROM f LEFT JOIN d USING (id) WHERE NOT (NOT gov AND {_m('name', tags.BORDER_NAME)} AND NOT {_m('name', 'weigh|scale')} AND coalesce(km <= 40, false))")
def jon12_near_border(spark, sf):
    found = views.objects(spark, sf).select("id", "lat", "lon", F.try_element_at("tags", F.lit("name")).alias("name"), tags.is_government().alias("gov"))
    return borders.away_from_border(found, _outline(spark, sf), 40.0).select("id")


_ROUTES = ("I-75N", "I40 EB", "I90/EB", "US61/151 NB", "I39/NB/SB", "I-35E", "I-69 WB", "US 9W", "US 41 NB", " SR 12 ", "")
_WAYS = ("", "EB", "Clockwise", "NB")
_NAMED = ("Osceola - Northbound", "Weigh Station (Eastbound)", "Fremont", "truck weigh scales", "I 75 Weigh Point", "", "Weigh Station, no facilities", "Big – Town  west bound yard", "North bound, South bound")
_PICK = lambda values, div: f"([{', '.join(repr(v) for v in values)}])[1 + (id // {div}) % {len(values)}]"
_CLEAN = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '\\s+[-–—]+\\s+|\\s*[–—]\\s*', ', ', 'g'), '\\s+', ' ', 'g'), '^[,\\s-]+|[,\\s-]+$', '', 'g'))"
_FACES = r"CASE upper(w) WHEN 'N' THEN 'northbound' WHEN 'S' THEN 'southbound' WHEN 'E' THEN 'eastbound' WHEN 'W' THEN 'westbound' END"
_INTER, _ANY = r"(?i)^(I[-\s]?(\d+))\s*/?\s*([NSEW])B?$", r"(?i)^(.+?\d)\s*/?\s*([NSEW])B$"
_WEIGH = rf"""r AS (SELECT id, {_PICK(_NAMED, 1)} AS name, {_PICK(_ROUTES, 9)} AS route, {_PICK(_WAYS, 7)} AS way FROM v_point),
s AS (SELECT *, trim(route) AS t, {_CLEAN('name')} AS b FROM r),
u AS (SELECT *, regexp_matches(t, '(?i)[NSEW]B?\s*/\s*[NSEW]B') AS two, regexp_matches(t, '{_INTER}') AS i, regexp_matches(t, '{_ANY}') AS o, lower(regexp_extract(b, '{tags.BOUND_WORD}', 1)) AS word FROM s),
x AS (SELECT *, two OR NOT (i OR o) OR (i AND regexp_extract(t, '{_INTER}', 2) IN ('35', '69') AND upper(regexp_extract(t, '{_INTER}', 3)) IN ('E', 'W') AND NOT regexp_matches(t, '(?i)B$')) AS whole FROM u),
y AS (SELECT *, CASE WHEN whole THEN t WHEN i THEN regexp_extract(t, '{_INTER}', 1) ELSE regexp_extract(t, '{_ANY}', 1) END AS road, CASE WHEN whole THEN '' WHEN i THEN regexp_extract(t, '{_INTER}', 3) ELSE regexp_extract(t, '{_ANY}', 2) END AS w,
  {_CLEAN(f"regexp_replace(b, '{tags.BOUND_WORD}', '')")} AS rest FROM x),
z AS (SELECT id, CASE WHEN rest <> '' AND NOT regexp_matches(rest, '{tags.GENERIC_NAME}') THEN rest ELSE 'Weigh station' END AS base, {_CLEAN('road')} AS road,
  coalesce(CASE way WHEN 'EB' THEN 'eastbound' WHEN 'NB' THEN 'northbound' WHEN '' THEN NULL ELSE lower(way) END, {_FACES}, CASE WHEN word <> '' THEN word || 'bound' END) AS dir FROM y),
q AS (SELECT *, CASE WHEN road <> '' AND NOT contains(regexp_replace(lower(base), '[-\s]', '', 'g'), regexp_replace(lower(road), '[-\s]', '', 'g')) THEN road END AS shown FROM z)"""


@query(f", {_WEIGH} SELECT id, base, road, dir, CASE WHEN concat_ws(' ', shown, dir) = '' THEN base ELSE base || ', ' || concat_ws(' ', shown, dir) END AS joined FROM q")
def cls06_weigh_names(spark, sf):
    pick = lambda values, div: F.element_at(F.array(*(F.lit(v) for v in values)), (F.expr(f"id div {div}") % len(values) + 1).cast("int"))
    rows = views.points(spark, sf).select("id", pick(_NAMED, 1).alias("name"), pick(_ROUTES, 9).alias("route"), pick(_WAYS, 7).alias("way"))
    parts = tags.weigh_parts(F.col("name"), F.col("route"), F.col("way"))
    return rows.select("id", *(parts[k].alias(k) for k in ("base", "road", "dir")), tags.join_weigh(parts).alias("joined"))


_SIGNS = ("I 80", "i-5", "US 30", "U30", "S12", "C 7A", "IH1", "I2", "IA3", "UA4", "", " ", "X9", "i-h2")


@query(f""", r AS (SELECT id, {_PICK(_SIGNS, 1)} AS sign, id % 3 AS code, lon - CASE WHEN id % 2 = 0 THEN 30 ELSE 0 END AS lon FROM v_point), u AS (SELECT *, upper(regexp_replace(sign, '[\\s-]+', '', 'g')) AS s FROM r),
n AS (SELECT id, CASE WHEN trim(sign) = '' THEN NULL WHEN regexp_matches(s, '^I\\d$') AND lon < -129 THEN 'IA' || s[2:] ELSE s END AS sign, regexp_matches(trim(sign), '(?i)^I[- ]?[AH]?[- ]?\\d') OR code = 2 AS inter FROM u),
p AS (SELECT *, regexp_extract(sign, '^([IUSC])([AH]?)(\\d+[A-Z]*)$', 1) AS k, regexp_extract(sign, '^([IUSC])([AH]?)(\\d+[A-Z]*)$', 2) AS l, regexp_extract(sign, '^([IUSC])([AH]?)(\\d+[A-Z]*)$', 3) AS d FROM n)
SELECT id, sign, inter, CASE WHEN k = '' OR (l <> '' AND k <> 'I') THEN NULL WHEN l <> '' THEN l || d ELSE CASE k WHEN 'I' THEN 'I' WHEN 'U' THEN 'US' WHEN 'S' THEN 'SR' ELSE 'CR' END || ' ' || d END AS short,
CASE WHEN k = '' OR (l <> '' AND k <> 'I') THEN NULL ELSE CASE WHEN l <> '' THEN l || d ELSE CASE k WHEN 'I' THEN 'I' WHEN 'U' THEN 'US' WHEN 'S' THEN 'State route' ELSE 'County road' END || ' ' || d END || CASE WHEN inter THEN ', interstate' ELSE ', not an interstate' END END AS long FROM p""")
def cls07_route_names(spark, sf):
    sign = F.element_at(F.array(*(F.lit(v) for v in _SIGNS)), (F.col("id") % len(_SIGNS) + 1).cast("int"))
    rows = views.points(spark, sf).select("id", sign.alias("raw"), (F.col("id") % 3).alias("code"), (F.col("lon") - F.when(F.col("id") % 2 == 0, 30).otherwise(0)).alias("lon"))
    rows = rows.select("id", tags.sign_of(F.col("raw"), F.col("lon")).alias("sign"), tags.is_interstate(F.col("raw"), F.col("code")).alias("inter"))
    short, long = tags.route_name(F.col("sign"), F.col("inter"))
    return rows.select("id", "sign", "inter", short.alias("short"), long.alias("long"))


_FOLD = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[.''’‘ʼʻ]', '', 'g'), '-', ' ', 'g'), '\\s*,\\s*', ', ', 'g'), '\\s+', ' ', 'g')), ',$', ''), '\\bsaint\\b', 'st', 'g'), '\\bfort\\b', 'ft', 'g'), '\\bmount\\b', 'mt', 'g')"
_PLACES = f"""l AS (SELECT ord, {_FOLD('name')} AS name, state FROM v_town), c AS (SELECT lower(code) AS code, lower(name) AS name FROM v_code),
t AS (SELECT qid, {_FOLD('q')} AS t FROM v_typed), a AS (SELECT *, EXISTS (SELECT 1 FROM c WHERE c.code = t.t OR c.name = t.t) AS alone FROM t WHERE t <> ''),
e AS (SELECT qid, arg_max(code, length(name)) AS code, max(length(name)) AS n FROM a JOIN c ON NOT alone AND length(t) > length(name) + 1 AND ends_with(t, ' ' || name) GROUP BY qid),
r AS (SELECT a.*, regexp_replace(CASE WHEN e.n IS NULL THEN t ELSE regexp_replace(left(t, length(t) - e.n), ',? $', '') || ', ' || e.code END, ',? ([a-z]{{2}})$', ', \\1') AS read FROM a LEFT JOIN e USING (qid)),
k AS (SELECT qid, alone, t, read, read = t OR contains(t, ',') AS once, EXISTS (SELECT 1 FROM l WHERE l.name = r.t) AS listed FROM r),
x AS (SELECT qid, alone, 0 AS turn, CASE WHEN NOT once AND listed THEN t ELSE read END AS text FROM k UNION ALL SELECT qid, alone, 1, t FROM k WHERE NOT once AND NOT listed),
y AS (SELECT qid, alone, turn, split_part(text, ', ', 1) AS town, nullif(split_part(text, ', ', 2), '') AS state FROM x),
d AS (SELECT DISTINCT town, state, alone FROM y),
h AS (SELECT town, d.state, alone, CASE WHEN l.name = town THEN 0 WHEN town = 'new york' AND l.name = 'new york city' THEN 1 ELSE 2 END AS how, ord FROM d JOIN l ON (d.state IS NULL OR d.state = l.state) AND (l.name = town OR (town = 'new york' AND l.name = 'new york city') OR (NOT alone AND starts_with(l.name, town)))),
g AS (SELECT town, state, alone, how, count(*) AS n, min(ord) AS ord FROM h GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY town, state, alone ORDER BY how) = 1),
z AS (SELECT y.qid, turn, ord, CASE WHEN (y.alone AND y.town <> 'new york') OR NOT (n = 1 OR (y.state IS NOT NULL AND how < 2)) THEN 'ask' ELSE 'place' END AS outcome FROM y JOIN b ON y.town = b.town AND y.state IS NOT DISTINCT FROM b.state AND y.alone = b.alone QUALIFY row_number() OVER (PARTITION BY y.qid ORDER BY turn) = 1)"""


@query(f", {_PLACES} SELECT qid, coalesce(outcome, 'none') AS outcome, ord FROM v_typed LEFT JOIN z USING (qid)")
def jon07_resolve_places(spark, sf):
    return places.resolve_places(views.typed(spark, sf), views.towns(spark, sf), views.codes(spark, sf))

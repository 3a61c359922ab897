"""Readers of mapped objects, feature rows, national price pages, state dimensions and boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = "remark string, osm3s struct<timestamp_osm_base: string>, elements array<struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
FEATURES = "exceededTransferLimit boolean, features array<struct<attributes: map<string, string>, geometry: struct<x: double, y: double>>>"
BOUNDARIES = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
# Words of remarks that tell of a failed request, element types in their order, and words for no value.
FAILED = r"(?i)error|timed? ?out|runtime|too busy"
TYPE_ORDER = ("way", "node", "relation")
NO_VALUE = ("", "NA", "N/A", "NULL", "NONE")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Responses with tagged elements, one JSON document a file; damaged ones are an error."""
    return spark.read.schema(ELEMENTS).option("mode", "FAILFAST").option("multiLine", True).json(path).withColumn("response", F.col("_metadata.file_path"))


def load_tagged_elements(responses: DataFrame) -> DataFrame:
    """response, type, id, lat, lon, tags, reject: every element of responses (response, remark, osm3s, elements) that has a position.

    A position is the element's own or its centre's. reject is set where the response tells of an error or
    has no base time, or the element has another type or no id; a response that is rejected keeps its rows.
    Responses without elements give no rows.
    """
    base = F.col("osm3s.timestamp_osm_base")
    whole = F.when(F.col("remark").rlike(FAILED), "remark").when(~F.coalesce(base.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.lit(False)), "no base time")
    rows = responses.select("response", whole.alias("whole"), F.explode("elements").alias("e"))
    own = F.col("e.lat").isNotNull() & F.col("e.lon").isNotNull()
    at = lambda c: F.when(own, F.col(f"e.{c}")).otherwise(F.col(f"e.center.{c}"))
    unknown = F.when(~F.coalesce(F.col("e.type").isin(*TYPE_ORDER), F.lit(False)) | F.col("e.id").isNull(), "unknown element")
    tags = F.coalesce("e.tags", F.create_map().cast("map<string,string>"))
    out = rows.select("response", "e.type", "e.id", at("lat").alias("lat"), at("lon").alias("lon"), tags.alias("tags"), F.coalesce("whole", unknown).alias("reject"))
    return out.where("lat IS NOT NULL AND lon IS NOT NULL")


def known_value(text) -> F.Column:
    """Trimmed text, null for the words that mean no value."""
    return F.when(~F.upper(F.trim(text)).isin(*NO_VALUE), F.trim(text))


def flatten_feature_rows(responses: DataFrame, name: str, keep: str = "(?i)weigh|scale") -> DataFrame:
    """response, id, lat, lon, name, state, route, milepost, spots, reject of feature rows whose name attribute matches keep.

    Coordinates are the attributes latitude and longitude, else the geometry; rows without either are left
    out. Coordinates are rounded half even to 5 decimals. reject is set where a response was cut short or a row has no id.
    """
    a = lambda k: F.try_element_at("f.attributes", F.lit(k))
    rows = responses.select("response", F.coalesce("exceededTransferLimit", F.lit(False)).alias("short"), F.explode("features").alias("f"))
    lat, lon = a("latitude").try_cast("double"), a("longitude").try_cast("double")
    own = lat.isNotNull() & lon.isNotNull()
    at = lambda x, g: F.bround(F.when(own, x).otherwise(F.col(f"f.geometry.{g}")), 5)
    number = a("OBJECTID").try_cast("long")
    reject = F.when(F.col("short"), "cut short").when(number.isNull(), "no id")
    out = rows.select(
        "response", number.alias("id"), at(lat, "y").alias("lat"), at(lon, "x").alias("lon"), known_value(a(name)).alias("name"),
        known_value(a("state")).alias("state"), known_value(a("highway_route")).alias("route"), known_value(a("mile_post")).alias("milepost"),
        a("number_of_spots").try_cast("double").cast("int").alias("spots"), reject.alias("reject"),
    )
    return out.where(F.col("name").rlike(keep) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def extract_national_prices(pages: DataFrame, header: str = "Diesel", low: float = 1.5, high: float = 15.0) -> DataFrame:
    """page_id, as_of, current, yesterday, reject of pages (page_id, html) with a national price table.

    The column is that of the header, which must occur once; the rows that begin with "Current Avg." and
    "Yesterday Avg." must occur once each, with a price like $3.459 in range there, and the page must name
    exactly one date of the form "Price as of m/d/yy". Prices and date are null where reject is set.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>|&nbsp;", ""))
    html = F.coalesce("html", F.lit(""))
    heads = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<th[^>]*>(.*?)</th>"), F.lit(1)), plain)
    lines = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(lines, lambda tr: F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), plain))
    dates = F.array_distinct(F.regexp_extract_all(html, F.lit(r"Price as of\s+(\d{1,2}/\d{1,2}/\d{2})\b"), F.lit(1)))
    rows = pages.select("page_id", heads.alias("heads"), cells.alias("cells"), dates.alias("dates"))
    rows = rows.withColumn("at", F.array_position("heads", header).cast("int")).withColumn("times", F.size(F.filter("heads", lambda h: h == header)))
    of = lambda label: F.filter("cells", lambda c: F.try_element_at(c, F.lit(1)) == label)
    rows = rows.withColumn("now", of("Current Avg.")).withColumn("before", of("Yesterday Avg."))
    cell = lambda found: F.try_element_at(F.try_element_at(found, F.lit(1)), F.when(F.col("at") > 0, F.col("at")))
    price = lambda found: F.regexp_extract(cell(found), r"^\$(\d\.\d{2,4})$", 1).try_cast("decimal(7,4)")
    rows = rows.withColumn("current", price(F.col("now"))).withColumn("yesterday", price(F.col("before")))
    reject = (
        F.when(F.col("times") != 1, "header not once")
        .when((F.size("now") != 1) | (F.size("before") != 1), "row not once")
        .when(F.col("current").isNull() | F.col("yesterday").isNull(), "no price")
        .when(F.size("dates") != 1, "no single date")
        .when(~F.col("current").between(low, high) | ~F.col("yesterday").between(low, high), "out of range")
    )
    good = lambda c: F.when(F.col("reject").isNull(), c)
    as_of = F.try_to_date(F.try_element_at("dates", F.lit(1)), "M/d/yy")
    return rows.withColumn("reject", reject).select("page_id", good(as_of).alias("as_of"), good(F.col("current")).alias("current"), good(F.col("yesterday")).alias("yesterday"), "reject")


def check_states(states: DataFrame, series: DataFrame, expected: int) -> DataFrame:
    """code, name, series, reject: rows of a state dimension (code, name, series) with the first rule that they break.

    A code that occurs twice, a series that isn't in series (series), or a table of other than expected rows.
    """
    counted = states.groupBy("code").agg(F.count("*").alias("times"))
    whole = states.agg(F.count("*").alias("rows"))  # one row
    known = series.select(F.col("series").alias("known")).distinct()
    rows = states.join(counted, "code").join(known, F.col("series") == F.col("known"), "left").crossJoin(F.broadcast(whole))
    reject = F.when(F.col("times") > 1, "code twice").when(F.col("series").isNotNull() & F.col("known").isNull(), "unknown series").when(F.col("rows") != expected, "row count")
    return rows.select("code", "name", "series", reject.alias("reject"))


def boundary_edges(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (code, poly, ring, is_hole, x1, y1, x2, y2) and rejects (code, poly, reject) of shapes (code, poly, rings).

    rings is array<array<struct<x, y>>>, the outer ring first. A ring's repeat of its first vertex at the end
    is dropped; a polygon without rings or with a ring of fewer than 3 vertices is rejected whole.
    """
    open_ring = lambda r: F.when((F.size(r) > 1) & (F.try_element_at(r, F.lit(1)) == F.try_element_at(r, F.lit(-1))), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r)
    opened = shapes.select("code", "poly", F.transform("rings", open_ring).alias("rings"))
    reject = F.when(F.coalesce(F.size("rings"), F.lit(0)) < 1, "no rings").when(F.exists("rings", lambda r: F.size(r) < 3), "ring of fewer than 3 vertices")
    checked = opened.withColumn("reject", reject)
    rings = checked.where("reject IS NULL").select("code", "poly", F.posexplode("rings").alias("ring", "r"))
    ahead = F.transform("r", lambda p, i: F.struct(p.alias("p"), F.get("r", (i + 1) % F.size("r")).alias("q")))
    edges = rings.select("code", "poly", "ring", (F.col("ring") > 0).alias("is_hole"), F.explode(ahead).alias("e"))
    edges = edges.select("code", "poly", "ring", "is_hole", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))
    return edges, checked.where("reject IS NOT NULL").select("code", "poly", "reject")


def read_boundaries(spark: SparkSession, path: str, code: str) -> DataFrame:
    """code, poly, rings of GeoJSON files of polygons; code is the property that names the state."""
    docs = spark.read.schema(BOUNDARIES).option("mode", "FAILFAST").option("multiLine", True).json(path)
    rows = docs.select(F.explode("features").alias("f")).select(F.try_element_at("f.properties", F.lit(code)).alias("code"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    many = F.from_json("c", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("kind") == "MultiPolygon", many).otherwise(F.array(F.from_json("c", "array<array<array<double>>>")))
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select("code", F.posexplode(polygons).alias("poly", "p")).select("code", "poly", F.transform("p", points).alias("rings"))


def read_boundaries_kml(spark: SparkSession, path: str, code: str) -> DataFrame:
    """code, poly, rings of KML placemarks; code is the name of the data field that names the state."""
    ring = "struct<LinearRing: struct<coordinates: string>>"
    polygon = f"array<struct<outerBoundaryIs: {ring}, innerBoundaryIs: array<{ring}>>>"
    schema = f"ExtendedData struct<SchemaData: struct<SimpleData: array<struct<_name: string, _VALUE: string>>>>, Polygon {polygon}, MultiGeometry struct<Polygon: {polygon}>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    named = F.filter("ExtendedData.SchemaData.SimpleData", lambda d: d["_name"] == code)
    pairs = lambda text: F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != ""), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))
    inner = F.coalesce(F.transform("g.innerBoundaryIs", lambda b: b["LinearRing"]["coordinates"]), F.array().cast("array<string>"))
    rings = F.transform(F.concat(F.array("g.outerBoundaryIs.LinearRing.coordinates"), inner), pairs)
    each = rows.select(F.try_element_at(named, F.lit(1))["_VALUE"].alias("code"), F.posexplode(F.coalesce("MultiGeometry.Polygon", "Polygon")).alias("poly", "g"))
    return each.select("code", "poly", rings.alias("rings"))

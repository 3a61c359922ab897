"""Readers of price documents, snapshots, tables of cells, features and raw pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEEKLY = "schema string, weeks array<struct<period: date, values: map<string, double>>>"
SNAPSHOT = "as_of date, values map<string, double>"
# Columns of the gazetteer's tab-separated files.
GAZETTEER = "id long, name string, ascii string, other string, lat double, lon double, class string, code string, country string, cc2 string, state string, county string, a3 string, a4 string, population long, elevation string, dem string, zone string, modified date"
# Columns of a point list.
POINT_LIST = ("ID", "Address", "Name", "Latitude", "Longitude", "Radius", "Tags", "Notes", "Type")


def read_weekly(spark: SparkSession, path: str, schema_id: str) -> DataFrame:
    """series, period, price of weekly documents; documents of another schema give no rows, damaged ones are an error. Null prices stay."""
    docs = spark.read.schema(WEEKLY).option("mode", "FAILFAST").json(path).where(F.col("schema") == schema_id)
    weeks = docs.select(F.explode("weeks").alias("w"))
    return weeks.select(F.explode("w.values").alias("series", "price"), F.col("w.period").alias("period")).select("series", "period", "price")


def read_snapshots(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """as_of, code, value of snapshot files in folders named by date; folders without a date are ignored and the name must equal the date inside."""
    found = spark.read.schema(SNAPSHOT).option("recursiveFileLookup", True).json(path)
    named = F.try_to_date(F.regexp_extract(F.col("_metadata.file_path"), r"[/=](\d{4}-\d{2}-\d{2})(\.json)?(/[^/]*)?$", 1), "yyyy-MM-dd")
    rows = found.withColumn("_named", named).where(F.col("_named") == F.col("as_of")).drop("_named")
    if newest is not None:
        rows = rows.join(rows.select("as_of").distinct().orderBy(F.desc("as_of")).limit(newest), "as_of", "left_semi")
    return rows.select("as_of", F.explode("values").alias("code", "value"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GAZETTEER).option("mode", "FAILFAST").csv(path, sep="\t", quote="")


def read_point_list(spark: SparkSession, path: str) -> DataFrame:
    """Points of a CSV with its header; coordinates that aren't numbers become null. A missing column is an error."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    missing = [c for c in POINT_LIST if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    number = lambda c: F.when(F.isnan(F.col(c).try_cast("double")), None).otherwise(F.col(c).try_cast("double"))
    return rows.withColumn("Latitude", number("Latitude")).withColumn("Longitude", number("Longitude"))


def normalize_weekly_grid(cells: DataFrame, first: str, low: int, high: int) -> DataFrame:
    """series, period, mills, reject: cells (series, period, price text) checked and rounded half up to mills.

    reject names the first rule broken: not a Monday, twice, not a number or out of range; it is null for
    good rows. Rows before `first` and weeks without any price are left out; blank prices are null.
    """
    blank = F.trim(F.coalesce("price", F.lit(""))) == ""
    rows = cells.where(F.col("period") >= F.lit(first).cast("date")).withColumn("_blank", blank)
    week, cell = Window.partitionBy("period"), Window.partitionBy("series", "period")
    rows = rows.withColumn("_any", F.max(~F.col("_blank")).over(week)).withColumn("_n", F.count("*").over(cell)).where("_any")
    number = F.col("price").try_cast("decimal(18,6)")
    mills = F.when(~F.col("_blank"), F.floor(number * 1000 + F.lit(0.5).cast("decimal(2,1)")).cast("long"))
    reject = F.when(F.weekday("period") != 0, "not a Monday").when(F.col("_n") > 1, "twice").when(~F.col("_blank") & number.isNull(), "not a number").when(~mills.between(low, high), "out of range")
    return rows.select("series", "period", mills.alias("mills"), reject.alias("reject"))


def regional_feed(feed: DataFrame, names: DataFrame, keys: int, n: int) -> DataFrame:
    """series, period, mills of a feed (period, region, price text): its newest n dates whose `keys` regions are all there.

    names maps region to series and is small: a row for each region. It is an error if the newest date has a region
    that names doesn't have or lacks one that it has, and if any of the n dates isn't a Monday, has a region twice or a
    price that is no number. An older date that isn't whole is left out: only a whole week may replace stored data.
    """
    recent = feed.join(feed.select("period").distinct().orderBy(F.desc("period")).limit(n), "period", "left_semi")
    known = F.broadcast(names.select(F.trim("region").alias("_region"), "series"))
    rows = recent.join(known, F.trim("region") == F.col("_region"), "left").drop("_region")
    priced = F.col("series").isNotNull() & (F.coalesce(F.trim("price"), F.lit("")) != "")
    number = F.col("price").try_cast("decimal(18,6)")
    seen = rows.groupBy("period").agg(
        F.min(F.when(F.col("series").isNull(), F.coalesce("region", F.lit("")))).alias("unknown"), F.count_distinct(F.when(priced, F.col("series"))).alias("have"),
        (F.count("series") > F.count_distinct("series")).alias("twice"), F.min(F.when(priced & number.isNull(), F.col("price"))).alias("bad"),
    )
    newest = feed.agg(F.max("period").alias("newest"))  # one row
    first, day = F.col("period") == F.col("newest"), F.col("period").cast("string")
    problem = (
        F.when(F.weekday("period") != 0, F.concat(day, F.lit(" is not a Monday")))
        .when(F.col("twice"), F.concat(day, F.lit(" has a region twice")))
        .when(F.col("bad").isNotNull(), F.concat(F.lit("no number: "), F.col("bad")))
        .when(first & F.col("unknown").isNotNull(), F.concat(F.lit("unknown region: "), F.col("unknown")))
        .when(first & (F.col("have") < keys), F.concat(day, F.lit(" is not whole")))
    )
    whole = seen.crossJoin(F.broadcast(newest)).withColumn("problem", problem)
    whole = whole.where(F.when(F.col("problem").isNull(), (F.col("have") == keys) & F.col("unknown").isNull()).otherwise(F.raise_error(F.col("problem")).cast("boolean")))
    return rows.where(priced).join(whole.select("period"), "period", "left_semi").select("series", "period", F.floor(number * 1000 + F.lit(0.5).cast("decimal(2,1)")).cast("long").alias("mills"))


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, n, href, label of every link of raw pages, in order, tags removed from labels."""
    pattern = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.posexplode(both).alias("n", "l"))
    return rows.select("page_id", "n", F.col("l.href").alias("href"), F.trim(F.regexp_replace("l.label", "<[^>]*>", "")).alias("label"))


def extract_state_prices(pages: DataFrame, column: str = "Diesel") -> DataFrame:
    """page_id, as_of, code, price, reject of pages with a table of state prices.

    The table is the one whose id is sortable. A row of its body links to state=XX and holds a price like $3.459 in the
    cell under the heading `column`. reject is set on a page without the table or the heading, with a row that isn't
    such, without rows, with a state twice, or with not exactly one real date of the form "Price as of m/d/yy".
    """
    dates = F.array_distinct(F.regexp_extract_all("html", F.lit(r"Price as of\s+(\d{1,2}/\d{1,2}/\d{2})\b"), F.lit(1)))
    held = lambda of, pattern: F.regexp_extract_all(of, F.lit(pattern), F.lit(1))
    plain = lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>|\s+", " "))
    table = F.nullif(F.regexp_extract("html", r"""(?is)<table\b[^>]*\bid=["']?sortable\b[^>]*>(.*?)</table>""", 1), F.lit(""))
    parts = pages.select("page_id", dates.alias("d"), table.alias("table"))
    heads = F.transform(held(F.regexp_extract("table", r"(?is)<thead\b[^>]*>(.*?)</thead>", 1), r"(?is)<th\b[^>]*>(.*?)</th>"), plain)
    parts = parts.withColumn("at", F.array_position(heads, column).cast("int"))
    body = F.coalesce(F.nullif(F.regexp_extract("table", r"(?is)<tbody\b[^>]*>(.*?)(</tbody>|$)", 1), F.lit("")), F.regexp_replace("table", r"(?is)<thead\b.*?</thead>", ""))
    rows = parts.select("page_id", "d", "table", "at", F.explode_outer(held(body, r"(?is)<tr\b[^>]*>(.*?)</tr>")).alias("tr"))
    cell = plain(F.try_element_at(held("tr", r"(?is)<td\b[^>]*>(.*?)</td>"), F.when(F.col("at") > 0, F.col("at"))))
    price = F.nullif(F.regexp_extract(cell, r"^\$(\d\.\d{2,4})$", 1), F.lit("")).cast("decimal(6,4)")
    parsed = rows.select("page_id", "d", "table", "at", "tr", F.nullif(F.regexp_extract("tr", r"state=([A-Z]{2})", 1), F.lit("")).alias("code"), price.alias("price"))
    good, page = F.col("code").isNotNull() & F.col("price").isNotNull(), Window.partitionBy("page_id")
    as_of = F.try_to_date(F.try_element_at("d", F.lit(1)), "M/d/yy")
    n, bad, kinds = F.count_if(good).over(page), F.count_if(F.col("tr").isNotNull() & ~good).over(page), F.size(F.collect_set(F.when(good, F.col("code"))).over(page))
    reject = F.when(F.col("table").isNull(), "no table").when(F.coalesce("at", F.lit(0)) == 0, "no such column").when(bad > 0, "bad row").when(n == 0, "no rows").when(n != kinds, "state twice").when((F.size("d") != 1) | as_of.isNull(), "no single date")
    checked = parsed.withColumn("reject", reject).where(good | F.col("reject").isNotNull())
    kept = lambda c, name: F.when(F.col("reject").isNull(), c).alias(name)
    return checked.select("page_id", kept(as_of, "as_of"), kept(F.col("code"), "code"), kept(F.col("price"), "price"), "reject").distinct()


def classify_fetches(responses: DataFrame, markers: list[str]) -> DataFrame:
    """responses (status, mitigated, body) with outcome: blocked, error or ok."""
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(F.coalesce("body", F.lit("")), F.lit(m))
    blocked = F.col("status").isin(403, 429, 503) | F.col("mitigated").isNotNull() | marked
    return responses.withColumn("outcome", F.when(blocked, "blocked").when(F.col("status") == 200, "ok").otherwise("error"))


def normalize_tax(rows: DataFrame, low: int, high: int) -> DataFrame:
    """rows (code, rate, effective date) with mils and reject: dollars (under 1.5) become cents before rounding; 0 without a date is no rate."""
    cents = F.when(F.col("rate") < 1.5, F.col("rate") * 100).otherwise(F.col("rate"))
    mils = F.when((F.col("rate") == 0) & F.col("effective").isNull(), None).otherwise(F.floor(cents * 1000 + 0.5))
    reject = F.when(F.col("rate") < 0, "negative").when((F.col("rate") == 0) & F.col("effective").isNotNull(), "zero with a date").when(~mils.between(low, high), "out of band")
    return rows.withColumn("mils", mils).withColumn("reject", reject)


def fold_continuation_lines(lines: DataFrame, by: list[str], row: str, name: str, text: str) -> DataFrame:
    """name, text: rows without a name continue the one before; texts are joined by a space in order of row."""
    order = Window.partitionBy(*by).orderBy(row)
    filled = lines.withColumn("_run", F.count(F.nullif(F.trim(name), F.lit(""))).over(order))
    parts = filled.groupBy(*by, "_run").agg(F.min_by(name, row).alias(name), F.array_sort(F.collect_list(F.struct(row, text))).alias("_t"))
    return parts.select(*by, name, F.concat_ws(" ", F.transform("_t", lambda t: t[text])).alias(text))


def flatten_points(features: DataFrame, test: Column | None = None) -> DataFrame:
    """id, lat, lon of features (id, geometry struct<x, y>, props map): the geometry, else the properties lat and lon; features without a position are left out."""
    number = lambda *names: F.coalesce(*(F.try_element_at("props", F.lit(n)).try_cast("double") for n in names))
    rows = features if test is None else features.where(test)
    out = rows.select("id", F.coalesce("geometry.y", number("lat", "Lat", "LATITUDE")).alias("lat"), F.coalesce("geometry.x", number("lon", "Lon", "LONGITUDE")).alias("lon"))
    return out.where("lat IS NOT NULL AND lon IS NOT NULL")


# Names under which layers keep a point's position, in the order in which they are tried.
LAT_NAMES = ("Lat", "LATITUDE", "Latitude", "lat", "Y_LAT")
LON_NAMES = ("long", "LONGITUDE", "Longitude", "long_", "Lon", "X_LONG")


def property_test(field: str, how: str, value: str) -> Column:
    """Whether a property equals, excludes, startswith or contains a value, in any case; a missing property reads as empty."""
    own, value = F.lower(F.coalesce(F.try_element_at("props", F.lit(field)), F.lit(""))), value.lower()
    tests = {"equals": own == value, "excludes": ~F.contains(own, F.lit(value)), "startswith": F.startswith(own, F.lit(value)), "contains": F.contains(own, F.lit(value))}
    if how not in tests:
        raise ValueError(f"no such test: {how}")
    return tests[how]


def geojson_points(features: DataFrame, test: Column | None = None, edited: tuple[str, ...] = ()) -> DataFrame:
    """id, lat, lon, edited_on of features (id, geometry as JSON text, props map) that pass the test.

    The position is the geometry's first vertex, of whatever kind it is, else the properties under the first of LAT_NAMES
    and LON_NAMES that has a value; features without a position are left out, and so are those whose properties are no
    numbers. edited_on is the latest day among the properties edited, which hold milliseconds since 1970.
    """
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    vertex = rf'"coordinates"\s*:[\[\s]*\[\s*{number}\s*,\s*{number}'
    at = lambda k: F.nullif(F.regexp_extract(F.coalesce("geometry", F.lit("")), vertex, k), F.lit("")).cast("double")
    prop = lambda names: F.coalesce(*(F.try_element_at("props", F.lit(n)) for n in names)).try_cast("double")
    own = at(1).isNotNull()
    rows = features if test is None else features.where(test)
    days = [F.to_date(F.timestamp_millis(F.try_element_at("props", F.lit(n)).try_cast("long"))) for n in edited]
    latest = F.lit(None).cast("date") if not days else days[0] if len(days) == 1 else F.greatest(*days)
    out = rows.select("id", F.when(own, at(2)).otherwise(prop(LAT_NAMES)).alias("lat"), F.when(own, at(1)).otherwise(prop(LON_NAMES)).alias("lon"), latest.alias("edited_on"))
    return out.where("lat IS NOT NULL AND lon IS NOT NULL")


def flatten_lines(features: DataFrame, codes: list[int] | None = None) -> DataFrame:
    """id, path, sign, code, state, points of features (id, sign, code, state, paths): one row for each path of two vertices or more.

    Signs lose blanks and control characters, state names are squeezed to single spaces; empty ones are null. Of
    codes, if they are given, others are left out. code and state may be missing.
    """
    for name, kind in (("code", "int"), ("state", "string")):
        if name not in features.columns:
            features = features.withColumn(name, F.lit(None).cast(kind))
    sign = F.nullif(F.regexp_replace(F.coalesce("sign", F.lit("")), r"[\s\x00-\x1f\x7f]+", ""), F.lit(""))
    state = F.nullif(F.trim(F.regexp_replace(F.coalesce("state", F.lit("")), r"\s+", " ")), F.lit(""))
    rows = features if codes is None else features.where(F.col("code").isin(codes))
    return rows.select("id", sign.alias("sign"), "code", state.alias("state"), F.posexplode("paths").alias("path", "points")).where(F.size("points") >= 2)


def label_values(cells: DataFrame, label: str) -> DataFrame:
    """sheet, row, value: the first cell that isn't blank to the right of each cell (sheet, row, col, text) that reads as label."""
    marks = cells.where(F.lower(F.trim("text")) == label.lower()).select("sheet", "row", F.col("col").alias("_at"))
    right = cells.where(F.trim("text") != "").join(marks, ["sheet", "row"]).where("col > _at")
    found = right.groupBy("sheet", "row", "_at").agg(F.min_by("text", "col").alias("value"))
    return marks.join(found, ["sheet", "row", "_at"], "left").select("sheet", "row", "value")


def whole_pages(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of pages (service, ...) whose count equals that of expected (service, n); services that don't match give none."""
    counts = pages.groupBy("service").agg(F.count("*").alias("n"))
    return pages.join(counts.join(expected, ["service", "n"], "left_semi"), "service", "left_semi")


def assemble_arcs(arcs: DataFrame, refs: DataFrame, scale: float) -> DataFrame:
    """ring, points: arcs (arc, deltas array<struct<dx, dy>>) summed up and joined in the order of refs (ring, n, arc, reversed); joint vertices are not repeated."""
    sofar = Window.partitionBy("arc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    steps = arcs.select("arc", F.posexplode("deltas").alias("i", "d"))
    at = F.struct("i", *((F.sum(f"d.d{c}").over(sofar) * scale).alias(c) for c in "xy"))
    laid = steps.select("arc", at.alias("p")).groupBy("arc").agg(F.array_sort(F.collect_list("p")).alias("points"))
    laid = laid.select("arc", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    parts = refs.join(arcs.select("arc"), "arc", "left_semi").join(laid, "arc", "left").withColumn("points", F.coalesce("points", F.array().cast(laid.schema["points"].dataType)))
    parts = parts.select("ring", "n", F.when(F.col("reversed"), F.reverse("points")).otherwise(F.col("points")).alias("points"))
    tail = F.when(F.col("n") > 0, F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0)))).otherwise(F.col("points"))
    ordered = parts.select("ring", "n", tail.alias("points")).groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("n", "points"))).alias("p"))
    return ordered.select("ring", F.flatten(F.transform("p", lambda p: p["points"])).alias("points"))

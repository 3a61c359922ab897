"""Price, tax, point and cell tables derived from the given tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First words of the invented names of pins.
WORDS = ("Weigh station EB", "Scale WB and EB,", "Port of Entry NB", "DOT inspection  southbound", "TA", "Perto", "Love’s shop", "Speedco", "Lube zone", "Pro Fleet", "tire scale", "Tarps", "the yard", "toll road", "driver only", "towing", "glass", "Parking", "truck repair", "Smith LLC", "UT 84083 weigh", "$5 wash", "call 555-123-4567", "весы", "")
#: Names, operators and one further tag of the invented mapped objects, by turns.
OBJECTS = (
    ("CAT Scale 12", "", "amenity", "weighbridge"), ("Peace Bridge Customs", "", "amenity", "weighbridge"), ("New Mexico Port of Entry", "New Mexico DOT", "", ""), ("Tijuana Mexico lane", "", "", ""),
    ("Ag check", "Department of Agriculture", "", ""), ("Smog check", "", "amenity", "vehicle_inspection"), ("DMV Weigh Station", "Virginia DMV", "amenity", "weighbridge"), ("Old Weigh Station", "", "", ""),
    ("Weigh Station", "", "disused:amenity", "weighbridge"), ("Weigh Station", "", "highway", "residential"), ("Scale House Rd", "", "", ""), ("Weigh Station", "", "railway", "station"), ("Weigh Station", "", "amenity", "fuel"),
    ("Grain Elevator Scale", "", "amenity", "weighbridge"), ("Truck Scales", "", "access", "private"), ("Scale 7", "", "amenity", "weighbridge"), ("Fremont Weigh Station", "", "amenity", "weighbridge"), ("Eastbound", "", "service", "weigh_station"),
    ("Motor Carrier Services", "", "", ""), ("BRAZIL Inspection Station", "", "", ""), ("Wayne Inspection Station", "", "", ""), ("I-80 Truck Scales", "", "", ""), ("Truck Scales", "", "brand", "One9"), ("Scale", "State Patrol", "", ""),
    ("", "", "brand:wikidata", "Q1872496"), ("AMBEST stop", "", "brand:wikidata", "Q7835892"), ("Port of Entry", "", "", ""), ("Weigh area", "", "barrier", "border_control"),
)
_OBJECTS = ", ".join("{" + ", ".join(f"'{k}': '{v}'" for k, v in zip(("name", "operator", "k", "v"), o)) + "}" for o in OBJECTS)
#: Names of the invented towns, and what is typed for them.
TOWNS = ("Dallas", "Saint Charles", "St. Charles", "New York City", "Rocky Mount", "West New York", "Plant City", "Plantation", "Wyoming", "Fort Worth", "Ab-Ville", "O'Fallon", "Springfield", "Salem")
TYPED = ("Dallas", "st charles", "New York", "rocky mount", "west new york", "Plant", "wyoming", "Fort Worth,", "ab ville", "OFallon", "Spring", "salem", "nowhere", "", "dal")
_LIST = ", ".join(f"'{w}'" for w in WORDS)

VIEWS = f"""
v_state AS (SELECT n_nationkey AS code, n_name AS name, n_regionkey AS region, CASE WHEN n_nationkey % 12 <> 5 THEN 'R' || n_regionkey END AS series FROM nation),
v_weekly AS (
  SELECT 'R' || n_regionkey AS series, period, CASE WHEN ((period - DATE '1995-01-02') // 7 + n_regionkey) % 29 <> 7
    THEN 1500 + floor(sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / (100 * sum(l_quantity::BIGINT)) + 0.5)::BIGINT END AS mills
  FROM (SELECT n_regionkey, date_trunc('week', l_shipdate)::DATE AS period, l_extendedprice, l_quantity
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY n_regionkey, period),
v_daily AS (SELECT ts::DATE AS as_of, (user_id % 25)::INTEGER AS code, 15000 + floor(sum(round(value * 100)::BIGINT)::DOUBLE / count(*))::BIGINT AS units FROM events GROUP BY 1, 2),
v_tax AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 12 <> 8 THEN 8000 + (n_nationkey % 11) * 6650 END AS mils, n_nationkey % 9 = 4 AS out_of_date FROM nation),
v_point AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS name,
  25 + ((p_partkey % 400) * 37 % 2400) / 100.0::DOUBLE + ((p_partkey * 31) % 13) * 0.0005::DOUBLE AS lat,
  -124 + ((p_partkey % 400) * 91 % 5700) / 100.0::DOUBLE + ((p_partkey * 17) % 11) * 0.0005::DOUBLE AS lon FROM part),
v_cell AS (SELECT n_nationkey AS code, 25 + 4.8::DOUBLE * (n_nationkey // 5) AS lat0, -124 + 11.4::DOUBLE * (n_nationkey % 5) AS lon0 FROM nation),
v_pin AS (SELECT id, CASE WHEN id % 25 = 24 AND id % 3 > 0 THEN NULL ELSE trim(([{_LIST}])[1 + id % 25] || CASE WHEN id % 25 < 24 THEN ' ' || name ELSE '' END) END AS name, lat, lon FROM v_point),
v_object AS (SELECT id, ([{_OBJECTS}])[1 + id % {len(OBJECTS)}] AS o, lat, lon FROM v_point),
v_town AS (SELECT c_custkey AS ord, ([{", ".join("'" + t.replace("'", "''") + "'" for t in TOWNS)}])[1 + c_custkey % {len(TOWNS)}] || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ' || (c_custkey // {len(TOWNS)} % 40)::VARCHAR END AS name,
  chr((97 + c_custkey % 5)::INTEGER) || chr((97 + c_custkey // 5 % 5)::INTEGER) AS state, 25 + c_custkey % 25 AS lat, -124 + c_custkey % 57 AS lon FROM customer),
v_typed AS (SELECT o_orderkey AS qid, ([{", ".join("'" + t.replace("'", "''") + "'" for t in TYPED)}])[1 + o_orderkey % {len(TYPED)}] || CASE o_orderkey // 15 % 5 WHEN 0 THEN '' WHEN 1 THEN ', a' || chr((97 + o_orderkey // 75 % 5)::INTEGER)
  WHEN 2 THEN ' north land ' || chr((97 + o_orderkey // 75 % 5)::INTEGER) WHEN 3 THEN ' b' || chr((97 + o_orderkey // 75 % 5)::INTEGER) ELSE ' land ' || chr((97 + o_orderkey // 75 % 5)::INTEGER) END AS q FROM orders),
v_code AS (SELECT chr((97 + n_nationkey // 5)::INTEGER) || chr((97 + n_nationkey % 5)::INTEGER) AS code, CASE WHEN n_nationkey < 5 THEN 'North Land ' || chr((97 + n_nationkey)::INTEGER) ELSE 'Land ' || chr((97 + n_nationkey - 5)::INTEGER) END AS name FROM nation WHERE n_nationkey < 10),
v_near AS (SELECT a.code, b.code AS mate FROM v_cell a JOIN v_cell b ON abs(a.code // 5 - b.code // 5) + abs(a.code % 5 - b.code % 5) = 1),
v_trip AS (SELECT s_suppkey AS trip_id, 25 + ((s_suppkey * 7 % 400) * 37 % 2400) / 100.0::DOUBLE AS lat1, -124 + ((s_suppkey * 7 % 400) * 91 % 5700) / 100.0::DOUBLE AS lon1,
  25 + (((s_suppkey * 13 + 13) % 400) * 37 % 2400) / 100.0::DOUBLE AS lat2, -124 + (((s_suppkey * 13 + 13) % 400) * 91 % 5700) / 100.0::DOUBLE AS lon2 FROM supplier)
"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").selectExpr("n_nationkey AS code", "n_name AS name", "n_regionkey AS region", "CASE WHEN n_nationkey % 12 <> 5 THEN concat('R', n_regionkey) END AS series")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, period (a Monday), mills; null on blank weeks."""
    of = F.broadcast(_t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))  # a fixed dimension of 25 rows
    sold = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date(F.date_trunc("week", "l_shipdate")).alias("period"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("qty"))
    by_supplier = sold.groupBy("l_suppkey", "period").agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"))  # before the join: a row per supplier and week
    regions = _t(spark, sf_dir, "supplier").join(of, F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_regionkey")
    sums = by_supplier.join(regions, F.expr("l_suppkey = s_suppkey")).groupBy("n_regionkey", "period").agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"))
    blank = F.expr("(datediff(period, DATE '1995-01-02') div 7 + n_regionkey) % 29 = 7")
    return sums.select(F.concat(F.lit("R"), "n_regionkey").alias("series"), "period", F.when(~blank, 1500 + F.floor(F.col("cents").cast("double") / (100 * F.col("qty")) + 0.5)).alias("mills"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("as_of"), (F.col("user_id") % 25).cast("int").alias("code"))
    return by.agg((15000 + F.floor(F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / F.count("*"))).alias("units"))


def taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").selectExpr("n_nationkey AS code", "CASE WHEN n_nationkey % 12 <> 8 THEN 8000 + (n_nationkey % 11) * 6650 END AS mils", "n_nationkey % 9 = 4 AS out_of_date")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "p_partkey"
    return _t(spark, sf_dir, "part").selectExpr(f"{k} AS id", "p_brand AS brand", "p_name AS name", f"25 + (({k} % 400) * 37 % 2400) / 100D + (({k} * 31) % 13) * 0.0005D AS lat", f"-124 + (({k} % 400) * 91 % 5700) / 100D + (({k} * 17) % 11) * 0.0005D AS lon")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").selectExpr("n_nationkey AS code", "25 + 4.8D * (n_nationkey div 5) AS lat0", "-124 + 11.4D * (n_nationkey % 5) AS lon0")


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, lat, lon: points with invented names, some empty or null."""
    first = F.element_at(F.array(*(F.lit(w) for w in WORDS)), (F.col("id") % 25 + 1).cast("int"))
    name = F.when((F.col("id") % 25 == 24) & (F.col("id") % 3 > 0), None).otherwise(F.trim(F.concat(first, F.when(F.col("id") % 25 < 24, F.concat(F.lit(" "), "name")).otherwise(""))))
    return points(spark, sf_dir).select("id", name.alias("name"), "lat", "lon")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, mate: states whose cells share a side."""
    c = states(spark, sf_dir).select("code")
    step = F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((-1, 0), (1, 0), (0, -1), (0, 1)))))
    moved = c.select("code", step.alias("s")).select("code", (F.expr("code div 5").cast("int") + F.col("s.y")).alias("y"), (F.col("code") % 5 + F.col("s.x")).alias("x"))
    return moved.where("y >= 0 AND x BETWEEN 0 AND 4").select("code", (F.col("y") * 5 + F.col("x")).alias("mate")).join(c.withColumnRenamed("code", "mate"), "mate", "left_semi").select("code", "mate")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id with the coordinates of both ends."""
    a, b = "(s_suppkey * 7 % 400)", "((s_suppkey * 13 + 13) % 400)"
    end = lambda k, n: (f"25 + ({k} * 37 % 2400) / 100D AS lat{n}", f"-124 + ({k} * 91 % 5700) / 100D AS lon{n}")
    return _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS trip_id", *end(a, 1), *end(b, 2))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon, tags: invented mapped objects at the points."""
    made = F.array(*(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in own)), F.array(*(F.lit(v) for _, v in own))) for own in ([(k, v) for k, v in (("name", n), ("operator", o), (k, v)) if k and v] for n, o, k, v in OBJECTS)))
    return points(spark, sf_dir).select("id", "lat", "lon", F.element_at(made, (F.col("id") % len(OBJECTS) + 1).cast("int")).alias("tags"))


def towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, name, state, lat, lon of invented towns, in a list's order."""
    k = F.col("c_custkey")
    first = F.element_at(F.array(*(F.lit(t) for t in TOWNS)), (k % len(TOWNS) + 1).cast("int"))
    name = F.when(k % 3 == 0, first).otherwise(F.concat(first, F.lit(" "), F.expr(f"cast(c_custkey div {len(TOWNS)} % 40 AS string)")))
    state = F.concat(F.char(97 + k % 5), F.char(97 + F.expr("c_custkey div 5 % 5")))
    return _t(spark, sf_dir, "customer").select(k.alias("ord"), name.alias("name"), state.alias("state"), (25 + k % 25).alias("lat"), (-124 + k % 57).alias("lon"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, q: places as they might be typed."""
    k, letter = F.col("o_orderkey"), F.char(97 + F.expr("o_orderkey div 75 % 5"))
    first, turn = F.element_at(F.array(*(F.lit(t) for t in TYPED)), (k % len(TYPED) + 1).cast("int")), F.expr("o_orderkey div 15 % 5")
    tails = [(1, ", a"), (2, " north land "), (3, " b"), (4, " land ")]
    tail = F.coalesce(*(F.when(turn == n, F.concat(F.lit(t), letter)) for n, t in tails), F.lit(""))
    return _t(spark, sf_dir, "orders").select(k.alias("qid"), F.concat(first, tail).alias("q"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name of ten invented states."""
    k = F.col("n_nationkey")
    name = F.when(k < 5, F.concat(F.lit("North Land "), F.char(97 + k))).otherwise(F.concat(F.lit("Land "), F.char(97 + k - 5)))
    return _t(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.concat(F.char(97 + F.expr("n_nationkey div 5")), F.char(97 + k % 5)).alias("code"), name.alias("name"))

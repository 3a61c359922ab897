"""Time-series operators over long tables (series columns, a date, a value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Stretches that the dates of an as-of join are cut into.
STRETCHES = 64


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], tolerance: int | None = None) -> DataFrame:
    """left with the values of the newest right row dated at or before it, in a sorted pass over both.

    The right row counts even if its values are null, but not without a date; beyond tolerance days it is as if there were none. A series is
    cut at quantiles of all dates into STRETCHES, each sorted on its own; what a stretch begins with is the last right row
    of those before it, found from one row a stretch and joined back. So a long series is spread over many tasks.
    """
    keys, right = [F.col(c) for c in by], right.where(F.col(right_on).isNotNull())
    rest = [c for c in left.columns if c not in by]
    a = left.select(*keys, F.col(left_on).alias("_on"), F.lit(1).alias("_side"), F.struct(*rest).alias("_left"), F.lit(None).cast("struct<" + ",".join(f"{n}:{t}" for n, t in right.select(F.col(right_on).alias("_at"), *values).dtypes) + ">").alias("_right"))
    b = right.select(*keys, F.col(right_on).alias("_on"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(F.col(right_on).alias("_at"), *values).alias("_right"))
    shares = F.array(*(F.lit(k / STRETCHES) for k in range(1, STRETCHES)))
    bounds = right.agg(F.array_distinct(F.percentile_approx(right_on, shares)).alias("_bounds"))  # one row
    rows = a.unionByName(b).crossJoin(F.broadcast(bounds)).withColumn("_stretch", F.coalesce(F.size(F.filter("_bounds", lambda x: x <= F.col("_on"))), F.lit(0))).drop("_bounds")

    sofar = Window.partitionBy(*by, "_stretch").orderBy("_on", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_right", F.last("_right", ignorenulls=True).over(sofar)).where("_side = 1")
    # A row for each stretch of a series: what it begins with is the last answer of those before.
    begun = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    known = rows.groupBy(*by, "_stretch").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col("_on"))).alias("_last"))
    known = known.withColumn("_carried", F.last("_last", ignorenulls=True).over(begun)).where("_carried IS NOT NULL").drop("_last")
    known = known.toDF(*(f"_k{i}" for i in range(len(by))), "_s", "_carried")
    meets = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip([*by, "_stretch"], [*(f"_k{i}" for i in range(len(by))), "_s"], strict=True)))
    found = found.join(known, meets, "left").withColumn("_right", F.coalesce("_right", "_carried"))
    near = F.lit(True) if tolerance is None else F.datediff("_on", "_right._at") <= tolerance
    return found.select(*by, "_left.*", *(F.when(near, F.col(f"_right.{v}")).alias(v) for v in values))


def moves(prices: DataFrame, by: list[str], on: str, price: Column, step: int) -> DataFrame:
    """price, prev, change (half up to step decimals), change_pct (from that change, 2 decimals) and direction (before rounding) against the row before."""
    before = Window.partitionBy(*by).orderBy(on)
    rows = prices.select(*by, on, price.alias("price")).withColumn("prev", F.lag("price").over(before))
    change = F.round(F.col("price") - F.col("prev"), step)
    pct = F.when(F.col("prev") != 0, F.round(change.cast("decimal(12,4)") / F.col("prev") * 100, 2))
    direction = F.when(F.col("price") > F.col("prev"), "up").when(F.col("price") < F.col("prev"), "down").when(F.col("price") == F.col("prev"), "flat")
    return rows.select(*by, on, "price", "prev", change.alias("change"), pct.alias("change_pct"), direction.alias("direction"))


def newest(points: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """The last point that isn't null."""
    return points.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max(F.struct(on, value)).alias("p")).select(*by, f"p.{on}", f"p.{value}")


def change_over(points: DataFrame, by: list[str], on: str, value: str, days: int, tolerance: int = 6) -> DataFrame:
    """Newest value against the newest value dated days before it or earlier, no older than tolerance days more."""
    last = newest(points, by, on, value)
    probe = last.select(*by, F.date_sub(on, days).alias("then"))
    found = as_of_join(probe, points.where(F.col(value).isNotNull()), by, "then", on, [value], tolerance).withColumnRenamed(value, "base")
    return last.join(found.select(*by, "base"), by, "left").select(*by, on, value, "base", (F.col(value) - F.col("base")).alias("change"))


def _windowed(points: DataFrame, by: list[str], on: str, value: str, days: int) -> DataFrame:
    whole = Window.partitionBy(*by)
    rows = points.where(F.col(value).isNotNull()).withColumn("_newest", F.max(on).over(whole)).withColumn("_first", F.min(on).over(whole))
    return rows.where(F.col(on) > F.date_sub("_newest", days))


def high_low(points: DataFrame, by: list[str], on: str, value: str, days: int = 364) -> DataFrame:
    """Highest and lowest value of the last days; ties go to the latest date. complete: history reaches back far enough."""
    day = F.unix_date(on)
    found = _windowed(points, by, on, value, days).groupBy(*by).agg(F.max(F.struct(F.col(value), F.col(on))).alias("h"), F.min(F.struct(F.col(value), -day)).alias("l"), F.max(F.datediff("_newest", "_first") >= days - 7).alias("complete"))
    low = found["l"]["col2"] if "col2" in found.schema["l"].dataType.names else found["l"][found.schema["l"].dataType.names[1]]
    return found.select(*by, F.col(f"h.{value}").alias("high"), F.col(f"h.{on}").alias("high_on"), F.col(f"l.{value}").alias("low"), F.date_from_unix_date((-low).cast("int")).alias("low_on"), "complete")


def spark_range(points: DataFrame, by: list[str], on: str, value: str, days: int = 364) -> DataFrame:
    """Low, high and last of the last days; a tied low is the earliest, a tied high the latest. Series under 2 points are left out."""
    found = _windowed(points, by, on, value, days).groupBy(*by).agg(F.min(F.struct(value, on)).alias("l"), F.max(F.struct(value, on)).alias("h"), F.max(F.struct(on, value)).alias("n"), F.count("*").alias("c"))
    return found.where("c >= 2").select(*by, F.col(f"l.{value}").alias("low"), F.col(f"l.{on}").alias("low_on"), F.col(f"h.{value}").alias("high"), F.col(f"h.{on}").alias("high_on"), F.col(f"n.{value}").alias("last"))


def peak_kind(points: DataFrame, by: list[str], on: str, value: str, days: int = 364) -> DataFrame:
    """kind of the newest point: record if over every earlier value, 52week if over those of the window, else null."""
    order = Window.partitionBy(*by).orderBy("_day")
    rows = points.where(F.col(value).isNotNull()).withColumn("_day", F.unix_date(on))
    rows = rows.withColumn("_all", F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_year", F.max(value).over(order.rangeBetween(-(days - 1), -1)))
    last = rows.groupBy(*by).agg(F.max(F.struct("_day", value, "_all", "_year")).alias("p"))
    kind = F.when(F.col(f"p.{value}") > F.col("p._all"), "record").when(F.col(f"p.{value}") > F.col("p._year"), "52week")
    return last.select(*by, F.date_from_unix_date("p._day").alias(on), F.col(f"p.{value}").alias(value), kind.alias("kind"))


def densify(points: DataFrame, by: list[str], on: str, value: str, step: int = 7) -> DataFrame:
    """Every step-th day from a series' first to its last date, null where there is no row."""
    spine = points.groupBy(*by).agg(F.min(on).alias("_a"), F.max(on).alias("_b")).select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {step} DAYS"))).alias(on))
    return spine.join(points.select(*by, on, value), [*by, on], "left")


def interpolate_daily(points: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """A value for every day between the first and last: a straight line between points that aren't null, flat at the ends."""
    rows = densify(points, by, on, value, 1)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(on).alias("d"), F.col(value).cast("double").alias("v")))
    order = Window.partitionBy(*by).orderBy(on)
    rows = rows.withColumn("_a", F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(point, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    share = F.datediff(on, "_a.d") / F.datediff("_b.d", "_a.d")
    line = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull() | (F.col("_a.d") == F.col("_b.d")), F.col("_a.v")).otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share)
    return rows.select(*by, on, line.alias(value))


def last_days(points: DataFrame, by: list[str], on: str, days: int) -> DataFrame:
    """Rows of the last days of each series, nulls kept."""
    rows = points.withColumn("_newest", F.max(on).over(Window.partitionBy(*by)))
    return rows.where(F.col(on) > F.date_sub("_newest", days)).drop("_newest")


def gap_days(points: DataFrame, by: list[str], on: str) -> DataFrame:
    """gap: days since the row before."""
    return points.withColumn("gap", F.datediff(on, F.lag(on).over(Window.partitionBy(*by).orderBy(on))))


def islands(samples: DataFrame, by: list[str], on: str, code: str) -> DataFrame:
    """Runs of rows with one code, in order of on: run, code, begin and end; rows without a code don't break a run."""
    order = Window.partitionBy(*by).orderBy(on)
    rows = samples.where(F.col(code).isNotNull())
    changed = rows.withColumn("_new", F.coalesce((F.lag(code).over(order) != F.col(code)).cast("int"), F.lit(1)))
    runs = changed.withColumn("run", F.sum("_new").over(order))
    return runs.groupBy(*by, "run", code).agg(F.min(on).alias("begin"), F.max(on).alias("end"))


def largest_remainder(parts: DataFrame, by: list[str], share: str, order: list[str], total: Column) -> DataFrame:
    """units: share rounded down, and one more for the largest remainders (ties in order) until total is reached."""
    whole = Window.partitionBy(*by)
    rows = parts.withColumn("_floor", F.floor(share)).withColumn("_left", total - F.sum(F.floor(share)).over(whole))
    ranked = rows.withColumn("_rank", F.row_number().over(whole.orderBy(F.desc(F.col(share) - F.col("_floor")), *order)))
    return ranked.withColumn("units", F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).drop("_floor", "_left", "_rank")


def weekly_move(points: DataFrame, by: list[str], on: str, value: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The newest row (null stays null) against the row before it: value, prev, change and pct of prev; columns in carry are the newest row's."""
    rows = points.withColumn("_prev", F.lag(value).over(Window.partitionBy(*by).orderBy(on)))
    last = rows.groupBy(*by).agg(F.max_by(F.struct(F.col(on), F.col(value), F.col("_prev").alias("prev"), *carry), on).alias("p")).select(*by, "p.*")
    change = F.col(value) - F.col("prev")
    return last.withColumn("change", change).withColumn("pct", F.when(F.col("prev") != 0, change / F.col("prev") * 100))


def benchmark_on_primary(primary: DataFrame, bench: DataFrame, by: list[str], on: str, value: str, bench_value: str, start, end) -> DataFrame:
    """primary from start to end and its last row before, each with the benchmark in effect; the edges carry the benchmark if primary has no row there."""
    inside = primary.where(F.col(on).between(start, end)).select(*by, on, value)
    before = newest(primary.where(F.col(on) < start), by, on, value)
    keys = primary.select(*by).distinct()
    edges = keys.select(*by, F.explode(F.array(start, end)).alias(on)).join(inside.select(*by, on), [*by, on], "left_anti")
    rows = inside.unionByName(before).unionByName(edges, allowMissingColumns=True)
    return as_of_join(rows, bench, by, on, on, [bench_value])


def cumulative(rows: DataFrame, by: list[str], order: list[str], amount: Column) -> DataFrame:
    """rows with total: amount summed up to each row in order."""
    return rows.withColumn("total", F.sum(amount).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))

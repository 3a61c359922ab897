"""Composite reports: what a user of the price data asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import per_mile_tenths
from ..operators import boards, relations, series


def region_board(weekly: DataFrame, states: DataFrame) -> DataFrame:
    """Per series: newest value, its change against the week before, the year's range, its peak and its members."""
    moved = series.moves(weekly, ["series"], "period", F.col("mills"), 0).groupBy("series").agg(F.max(F.struct("period", "price", "change", "direction")).alias("p")).select("series", "p.*")
    ranges = series.spark_range(weekly, ["series"], "period", "mills").select("series", "low", "high")
    peaks = series.peak_kind(weekly, ["series"], "period", "mills").select("series", "kind")
    members = states.where("series IS NOT NULL").groupBy("series").agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("members"), F.count("*").alias("n_members"))
    return moved.join(ranges, "series", "left").join(peaks, "series", "left").join(members, "series", "left")


def tax_panel(states: DataFrame, taxes: DataFrame, federal_mils: int) -> DataFrame:
    """Every state with its rate, total with the federal rate, and places from the top and bottom among current rates."""
    ranked = relations.competition_rank(taxes, "mils", ~F.col("out_of_date"))
    joined = states.select("code", "name").join(ranked, "code", "left")
    return joined.withColumn("total_mils", F.when(~F.col("out_of_date"), F.col("mils") + federal_mils))


def surcharge_table(weekly: DataFrame, bases: list[int], mpgs: list[float], weeks: int) -> DataFrame:
    """Surcharge in tenths of a cent a mile for the newest weeks, every base and every miles a gallon."""
    recent = relations.newest_n(weekly, "period", weeks)
    grid = F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.lit(float(m)).alias("mpg")) for b in bases for m in mpgs)))
    rows = recent.select("series", "period", "mills", grid.alias("g")).select("series", "period", "mills", "g.*")
    return rows.withColumn("tenths", per_mile_tenths(F.col("mills"), F.col("base"), F.col("mpg")))


def numbers_table(daily: DataFrame, weekly: DataFrame, states: DataFrame) -> DataFrame:
    """Every daily value of a state with the weekly value of its series in effect on that day."""
    rows = daily.join(states.select("code", "series"), "code").where("series IS NOT NULL")
    return series.as_of_join(rows, weekly, ["series"], "as_of", "period", ["mills"])


def latest_snapshot(states: DataFrame, weekly: DataFrame, daily: DataFrame, move: int = 100, apart: int = 200) -> DataFrame:
    """Every state with its newest daily units, the change against the snapshot before, its weekly price and its flags."""
    rows = relations.join_snapshots(states.select("code", "name", "series"), daily, "code", "as_of", "units")
    prices = weekly.groupBy("series").agg(F.max_by("mills", "period").alias("mills"))
    c, p = F.col("cur"), F.col("prev")
    flags = relations.row_flags(c, p, F.col("gap"), F.col("mills") * 10, F.col("series").isNotNull(), move, apart)
    joined = rows.join(prices, "series", "left")
    return joined.select("code", "name", "series", "cur", "prev", (c - p).alias("change"), "mills", F.array_join(flags, ",").alias("flags"))


def consistency(states: DataFrame, weekly: DataFrame, taxes: DataFrame) -> DataFrame:
    """rule, n: breaches of the rules that hold between the tables."""
    prices = relations.latest_prices(states, weekly, "series", "period")
    twice = weekly.groupBy("series", "period").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit("unique").alias("rule"), "n")
    keyed = states.select("code").join(taxes.select("code", F.lit(1).alias("known")), "code", "left")
    found = [
        relations.violations(weekly, {"monday": F.weekday("period") == 0}), twice,
        relations.violations(prices, {"surveyed has a price": F.col("series").isNull() | F.col("mills").isNotNull()}),
        relations.violations(keyed, {"tax keys": F.col("known").isNotNull()}),
        relations.violations(taxes, {"out of date has a rate": ~F.col("out_of_date") | F.col("mils").isNotNull()}),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def state_quotes(states: DataFrame, weekly: DataFrame, daily: DataFrame, taxes: DataFrame) -> DataFrame:
    """Every state with its price, change, percent, weekly price and current tax."""
    rows = latest_snapshot(states, weekly, daily).join(states.select("code", "region"), "code")
    pct = F.round(F.col("change") / F.col("prev") * 100, 2)
    tax = taxes.select("code", F.when(~F.col("out_of_date"), F.col("mils")).alias("mils"))
    return rows.join(tax, "code", "left").select("code", "name", "region", "cur", "change", pct.alias("pct"), "mills", "mils")


def then_and_now(weekly: DataFrame, spans: dict[str, int]) -> DataFrame:
    """Newest value of each series and its change over each span of days."""
    out = series.newest(weekly, ["series"], "period", "mills")
    for name, days in spans.items():
        found = series.change_over(weekly, ["series"], "period", "mills", days).select("series", F.col("change").alias(name))
        out = out.join(found, "series", "left")
    return out


def state_lines(states: DataFrame, weekly: DataFrame) -> DataFrame:
    """Every state with its series' price and how many states share it."""
    prices = relations.latest_prices(states.select("code", "name", "series"), weekly, "series", "period")
    shared = states.where("series IS NOT NULL").groupBy("series").agg(F.count("*").alias("_n"))
    plate = F.when(F.col("series").isNull(), "no survey").otherwise(F.concat(F.lit("average of "), F.col("_n").cast("string"), F.lit(" states")))
    return prices.join(shared, "series", "left").select("code", "name", "series", "mills", plate.alias("plate"))


def newest_weeks(weekly: DataFrame, n: int) -> DataFrame:
    """series, week_1 to week_n (the newest first) and change: the newest n weeks side by side, and what happened over them."""
    periods = weekly.select("period").distinct().orderBy(F.desc("period")).limit(n)  # n rows
    recent = weekly.join(F.broadcast(periods.agg(F.array_sort(F.collect_list("period")).alias("known"))), F.array_contains("known", F.col("period")))
    place = F.size("known") + 1 - F.array_position("known", F.col("period"))
    rows = recent.withColumn("k", place).groupBy("series").agg(*(F.max(F.when(F.col("k") == k, F.col("mills"))).alias(f"week_{k}") for k in range(1, n + 1)))
    return rows.withColumn("change", F.col("week_1") - F.col(f"week_{n}"))


def whole_board(weekly: DataFrame, states: DataFrame, us: str, apart: Column) -> DataFrame:
    """The region board with the country's row (series us) first: place, and covers, in words, the states that a row stands for."""
    board = region_board(weekly, states)
    surveyed = states.where("series IS NOT NULL")
    own = surveyed.groupBy("series").agg(F.count_if(~apart).alias("_n"), F.bool_or(apart).alias("_a"))
    every = surveyed.agg(F.count_if(~apart).alias("_n"), F.coalesce(F.bool_or(apart), F.lit(False)).alias("_a")).select(F.lit(us).alias("series"), "_n", "_a")
    said = own.where(F.col("series") != us).unionByName(every).select("series", boards.covers(F.col("_n"), F.col("_a")).alias("covers"))
    rows = board.join(said, "series", "left").withColumn("covers", F.coalesce("covers", F.lit("no states")))
    return rows.withColumn("place", F.row_number().over(Window.orderBy((F.col("series") != us).cast("int"), "series")))  # a row for each series


def board_notes(weekly: DataFrame, noun: str, since: str, flat_below: int = 10) -> DataFrame:
    """One row beside the board of the newest week: how many moved which way, who moved most, and who is at a record."""
    last = series.moves(weekly, ["series"], "period", F.col("mills"), 0).join(F.broadcast(weekly.agg(F.max("period").alias("period"))), "period").select("period", "series", "change")
    line = boards.key_line(last, ["period"], "change", noun, flat_below)
    biggest = boards.biggest_note(last, ["period"], "change", "series", flat_below)
    kinds = series.peak_kind(weekly, ["series"], "period", "mills").withColumn("_one", F.lit(1))
    record = boards.record_note(kinds, ["_one"], "kind", "series", noun, since).drop("_one")
    return line.join(biggest, "period", "left").crossJoin(F.broadcast(record))


def country_block(national: DataFrame, weekly: DataFrame, us: str, enabled: bool) -> DataFrame:
    """One row: mode; the newest two daily dates, the days between them and the national price with its move; the newest two weeks and the country's price with its move.

    national: as_of, mills. The mode is daily if it is enabled and there is a snapshot, else weekly, without a daily part.
    """
    dates = relations.last_two(national.where(F.lit(enabled)), "as_of").select(F.col("cur").alias("as_of"), F.col("prev").alias("prev_as_of"))
    weeks = relations.last_two(weekly, "period").select(F.col("cur").alias("period"), F.col("prev").alias("prev_period"))

    def with_prices(one: DataFrame, rows: DataFrame, on: str, name: str) -> DataFrame:
        at = rows.join(F.broadcast(one), F.col("_on").isin(F.col(on), F.col(f"prev_{on}")))
        pair = at.agg(F.max(F.when(F.col("_on") == F.col(on), F.col("_v"))).alias(name), F.max(F.when(F.col("_on") == F.col(f"prev_{on}"), F.col("_v"))).alias(f"{name}_prev"))
        return one.crossJoin(F.broadcast(pair)).withColumn(f"{name}_change", F.col(name) - F.col(f"{name}_prev"))

    daily = with_prices(dates, national.select(F.col("as_of").alias("_on"), F.col("mills").alias("_v")), "as_of", "national")
    of_week = with_prices(weeks, weekly.where(F.col("series") == us).select(F.col("period").alias("_on"), F.col("mills").alias("_v")), "period", "us")
    one = daily.crossJoin(F.broadcast(of_week)).withColumn("gap_days", F.datediff("as_of", "prev_as_of"))
    return one.withColumn("mode", F.when(F.col("as_of").isNotNull(), "daily").otherwise("weekly"))


def _past(points: DataFrame, by: str, on: str, value: str, tolerance: int, prefix: str) -> DataFrame:
    """by and, under the prefix, the newest point, the changes over 4 and 52 weeks, the year's high and low, their first date and the kind of peak."""
    rows = points.where(F.col(value).isNotNull())
    out = series.high_low(rows, [by], on, value).join(rows.groupBy(by).agg(F.min(on).alias("first")), by)
    for name, days in (("change_4w", 28), ("change_52w", 364)):
        out = out.join(series.change_over(rows, [by], on, value, days, tolerance).select(by, F.col("change").alias(name)), by)
    out = out.join(series.peak_kind(rows, [by], on, value).select(by, F.col(value).alias("price"), "kind"), by)
    return out.select(by, *(F.col(c).alias(prefix + c) for c in out.columns if c != by))


def past_year(states: DataFrame, daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """code, name, price, change_4w, change_52w, high, high_on, low, low_on, kind, basis_4w, basis, label: what became of each state's price.

    Figures are ten-thousandths. They come from the daily prices; where those don't reach 4 weeks back, the 4-week change is
    that of the state's weekly series, and where they don't reach a year back, all figures of the year are. A state
    without a weekly series keeps its short history, whose label names its first date. Daily points may be up to 3
    days older than asked, weekly ones not at all.
    """
    d = _past(daily.select("code", "as_of", "units"), "code", "as_of", "units", 3, "d_")
    w = _past(weekly.select("series", "period", (F.col("mills") * 10).alias("units")), "series", "period", "units", 0, "w_")
    rows = states.select("code", "name", "series").join(d, "code", "left").join(w, "series", "left")
    has_weekly, short = F.col("w_price").isNotNull(), ~F.coalesce("d_complete", F.lit(False))
    of_year = lambda c: F.when(has_weekly & short, F.col(f"w_{c}")).otherwise(F.col(f"d_{c}"))
    label = F.when(of_year("complete"), "past year").otherwise(F.concat(F.lit("since "), of_year("first").cast("string")))
    return rows.select(
        "code", "name", F.coalesce("d_price", "w_price").alias("price"), F.coalesce("d_change_4w", "w_change_4w").alias("change_4w"), *(of_year(c).alias(c) for c in ("change_52w", "high", "high_on", "low", "low_on", "kind")),
        F.when(F.col("d_change_4w").isNotNull(), "daily").when(F.col("w_change_4w").isNotNull(), "weekly").alias("basis_4w"), F.when(has_weekly & short, "weekly").when(F.col("d_price").isNotNull(), "daily").alias("basis"), label.alias("label"),
    )


def quote_board(states: DataFrame, weekly: DataFrame, daily: DataFrame, taxes: DataFrame) -> DataFrame:
    """state_quotes with the low and high of the past year, what they are from, and how far up that range the price is, in percent."""
    year = past_year(states, daily, weekly).select("code", "low", "high", "label")
    up = F.when(F.col("high") > F.col("low"), F.round((F.col("cur") - F.col("low")) / (F.col("high") - F.col("low")) * 100, 2))
    return state_quotes(states, weekly, daily, taxes).join(year, "code").withColumn("up_range", up)

"""Federal holidays, working days and release dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weekday names as next_day() takes them, Monday first.
DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def _observed(day: Column) -> Column:
    """A holiday on Saturday moves to Friday, one on Sunday to Monday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def federal_holidays(year: Column) -> Column:
    """Array of a calendar year's holidays as observed; New Year's Day may fall into the year before."""
    on = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    nth = lambda m, day, n: F.date_add(F.next_day(F.date_sub(on(m, 1), 1), DAYS[day]), 7 * (n - 1))
    last_monday_of_may = F.date_sub(F.next_day(F.date_sub(on(6, 1), 1), "MON"), 7)
    fixed = [_observed(on(m, d)) for m, d in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))]
    return F.array(*fixed, nth(1, 0, 3), nth(2, 0, 3), last_monday_of_may, nth(9, 0, 1), nth(10, 0, 2), nth(11, 3, 4))


def is_holiday(day: Column) -> Column:
    return F.array_contains(F.array_union(federal_holidays(F.year(day)), federal_holidays(F.year(day) + 1)), day)


def is_workday(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~is_holiday(day)


def calendar(periods: DataFrame, on: str) -> DataFrame:
    """day, next_workday (the day itself if it is one) for the years that periods touch; a row for each day."""
    span = periods.agg(F.min(on).alias("a"), F.max(on).alias("b"))
    days = span.select(F.explode(F.sequence(F.date_sub("a", 1), F.date_add("b", 30))).alias("day"))
    work = days.withColumn("work", F.when(is_workday(F.col("day")), F.col("day")))
    ahead = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(0, 9)  # one row for each day of the span; no gap between workdays is longer
    return work.select("day", is_holiday(F.col("day")).alias("holiday"), F.first("work", ignorenulls=True).over(ahead).alias("next_workday"))


def expected_release(periods: DataFrame, on: str) -> DataFrame:
    """periods with expected: the workday after the next survey Monday, or after the day that follows it if that Monday is a holiday."""
    days = calendar(periods, on)
    survey = F.date_add(on, 7)
    rows = periods.withColumn("_survey", survey).join(days.select(F.col("day").alias("_survey"), "holiday"), "_survey", "left")
    rows = rows.withColumn("_from", F.when(F.col("holiday"), F.date_add("_survey", 2)).otherwise(F.date_add("_survey", 1)))
    return rows.join(days.select(F.col("day").alias("_from"), F.col("next_workday").alias("expected")), "_from", "left").drop("_survey", "_from", "holiday")


def next_release(period: Column, expected: Column, stated: Column, today: Column) -> Column:
    """date, late: the stated date if it lies 8 days or more after the period, else the expected one."""
    date = F.when(F.datediff(stated, period) >= 8, stated).otherwise(expected)
    return F.struct(date.alias("date"), (date < today).alias("late"))


def real_date(text: Column) -> Column:
    """The date of a text like 2026-09-14; null for other shapes and for days that don't exist."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def short_date(day: Column) -> Column:
    """Sep 14."""
    return F.date_format(day, "MMM d")


def full_date(day: Column) -> Column:
    """Sep 14, 2026."""
    return F.date_format(day, "MMM d, yyyy")


def when(day: Column, reference: Column) -> Column:
    """The short date, with its year where it isn't that of reference."""
    return F.when(F.year(day) == F.year(reference), short_date(day)).otherwise(full_date(day))


def weekday_date(day: Column) -> Column:
    """Tuesday, Sep 22."""
    return F.date_format(day, "EEEE, MMM d")


def month_year(day: Column) -> Column:
    """June 2022."""
    return F.date_format(day, "MMMM yyyy")


def month_tick(day: Column, with_year: bool = False) -> Column:
    """Oct, or the year in January."""
    return F.when((F.month(day) == 1) | F.lit(with_year), F.year(day).cast("string")).otherwise(F.date_format(day, "MMM"))


def badge_date(day: Column) -> Column:
    """9/17/26."""
    return F.date_format(day, "M/d/yy")


def day_in_new_york(at: Column) -> Column:
    """The calendar day in New York of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(at, "America/New_York"))


def epoch_day(milliseconds: Column) -> Column:
    """The UTC day of milliseconds since 1970; null for null."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(milliseconds / 86_400_000).cast("int"))


def release_version(copyright_text: Column, description: Column, name: str) -> tuple[Column, Column]:
    """Version and day of compilation that a layer's texts tell of; null where they don't, or the day isn't one."""
    version = F.nullif(F.regexp_extract(F.coalesce(copyright_text, F.lit("")), rf"{name} Version (\d{{4}}\.\d{{2}}\.\d{{2}})", 1), F.lit(""))
    plain = F.regexp_replace(F.replace(F.replace(F.coalesce(description, F.lit("")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), r"<[^>]+>", " ")
    return version, F.try_to_date(F.regexp_extract(plain, r"compiled on ([A-Z][a-z]+ \d{1,2}, \d{4})", 1), "MMMM d, yyyy")

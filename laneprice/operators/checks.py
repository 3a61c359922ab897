"""Closed schemas, new snapshots against stored ones, freshness of data sets and changes that need leave."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut

#: Examples of a broken rule that are shown.
SHOWN = 5


class Field(NamedTuple):
    """What a column must hold; None: anything."""

    kind: str
    required: bool = True
    values: tuple | None = None
    low: float | None = None
    high: float | None = None
    pattern: str | None = None


def check(rows: DataFrame, fields: dict[str, Field], unique: tuple[tuple[str, ...], ...] = (), least: int = 0, most: int | None = None) -> DataFrame:
    """rule, n, examples: rules of a closed schema that rows break, with how many rows do and up to SHOWN values.

    Columns that aren't in fields, missing ones and those of another type break a rule once each; the rules on values
    count rows: required (null), values, low, high and pattern (a null breaks none of these). unique counts the rows
    beyond the first of each key; least and most bound the number of rows. Rules that hold aren't listed.
    """
    spark = rows.sparkSession
    types = dict(rows.dtypes)
    wrong = [(f"{c}: unknown column", 1) for c in rows.columns if c not in fields] + [(f"{c}: missing column", 1) for c in fields if c not in types]
    wrong += [(f"{c}: {types[c]} instead of {f.kind}", 1) for c, f in fields.items() if c in types and types[c] != f.kind]
    rules: dict[str, tuple[str, Column]] = {}
    for c, f in fields.items():
        if c not in types or types[c] != f.kind:
            continue
        if f.required:
            rules[f"{c}: null"] = c, F.col(c).isNull()
        if f.values is not None:
            rules[f"{c}: other value"] = c, ~F.col(c).isin(*f.values)
        if f.low is not None:
            rules[f"{c}: below {f.low}"] = c, F.col(c) < f.low
        if f.high is not None:
            rules[f"{c}: above {f.high}"] = c, F.col(c) > f.high
        if f.pattern is not None:
            rules[f"{c}: other shape"] = c, ~F.col(c).rlike(f.pattern)
    # One pass: every row names the rules that it breaks, and itself; equal values are counted before they are shuffled.
    text = F.lit(None).cast("string")
    named = [F.struct(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("v"), F.coalesce(bad, F.lit(False)).alias("bad")) for rule, (column, bad) in rules.items()]
    broken = F.filter(F.array(F.struct(F.lit("").alias("rule"), text.alias("v"), F.lit(True).alias("bad")), *named), lambda x: x["bad"])
    told = cut(rows.select(F.explode(broken).alias("x")).groupBy("x.rule", "x.v").agg(F.count("*").alias("n")))
    n = told.agg(F.coalesce(F.sum(F.when(F.col("rule") == "", F.col("n"))), F.lit(0))).first()[0]
    kind = "rule string, n long, examples array<string>"
    wrong += [(f"fewer than {least} rows", int(n < least)), (f"more than {most} rows", int(most is not None and n > most))]
    found = spark.createDataFrame([(rule, times, []) for rule, times in wrong if times], kind)
    first = F.row_number().over(Window.partitionBy("rule").orderBy(F.asc_nulls_last("v")))
    few = told.where("rule <> '' AND v IS NOT NULL").withColumn("k", first).where(F.col("k") <= SHOWN).groupBy("rule").agg(F.array_sort(F.collect_list("v")).alias("examples"))
    sums = told.where("rule <> ''").groupBy("rule").agg(F.sum("n").alias("n")).join(few, "rule", "left")
    found = found.unionByName(sums.select("rule", "n", F.coalesce("examples", F.array().cast("array<string>")).alias("examples")))
    for key in unique:
        again = rows.groupBy(*key).agg((F.count("*") - 1).alias("n")).where("n > 0")
        told = F.concat_ws(", ", *(F.col(c).cast("string") for c in key)).alias("v")
        few = again.select(told).orderBy("v").limit(SHOWN).agg(F.array_sort(F.collect_list("v")).alias("examples"))
        some = again.agg(F.sum("n").alias("n")).crossJoin(F.broadcast(few)).where("n > 0")  # one row each
        found = found.unionByName(some.select(F.lit(f"{', '.join(key)}: not unique").alias("rule"), "n", "examples"))
    return found


def snapshot_outcomes(pages: DataFrame, stored: DataFrame, codes: DataFrame, today: Column, low: float, high: float, move: float) -> DataFrame:
    """page, as_of, outcome, reason, warnings for new snapshots (page, as_of, code, price) against the newest stored one (as_of, code, price).

    invalid: another set of codes than codes (code), a code twice, a price that is null or out of range, a date after tomorrow, older than
    what is stored, or all prices as stored. noop: the stored date again. Else ok. Warnings: as_of_ahead
    (tomorrow), prev_missing (nothing stored), gap (more than a day since) and large_move (a price moved by move or more).
    """
    newest = stored.agg(F.max("as_of").alias("before"))  # one row
    last = stored.join(F.broadcast(newest), F.col("as_of") == F.col("before")).select("code", F.col("price").alias("was"))
    known = codes.select("code").distinct().withColumn("known", F.lit(True))
    whole = known.agg(F.count("*").alias("all"))  # one row
    rows = pages.join(known, "code", "left").join(last, "code", "left")
    sums = rows.groupBy("page", "as_of").agg(
        F.count("*").alias("n"), F.count_distinct("code").alias("kinds"), F.count("known").alias("known"), F.count_if(F.coalesce(~F.col("price").between(low, high), F.lit(True))).alias("bad"),
        F.bool_and(F.col("price").eqNullSafe(F.col("was"))).alias("same"), F.max(F.abs(F.col("price") - F.col("was"))).alias("moved"),
    )
    sums = sums.crossJoin(F.broadcast(newest)).crossJoin(F.broadcast(whole))
    late = F.datediff("as_of", today)
    reason = (
        F.when(F.col("n") != F.col("kinds"), "code twice").when((F.col("known") != F.col("n")) | (F.col("n") != F.col("all")), "other codes").when(F.col("bad") > 0, "price")
        .when(late > 1, "date ahead").when(F.col("as_of") < F.col("before"), "older").when((F.col("as_of") > F.col("before")) & F.col("same"), "all as before")
    )
    outcome = F.when(reason.isNotNull(), "invalid").when(F.col("as_of") == F.col("before"), "noop").otherwise("ok")
    gap = F.datediff("as_of", "before")
    warnings = F.array_compact(F.array(F.when(late == 1, "as_of_ahead"), F.when(F.col("before").isNull(), "prev_missing"), F.when(gap > 1, "gap"), F.when(F.col("moved") >= move, "large_move")))
    return sums.select("page", "as_of", outcome.alias("outcome"), reason.alias("reason"), F.when(reason.isNull(), warnings).otherwise(F.array().cast("array<string>")).alias("warnings"))


def dataset_health(datasets: DataFrame, runs: DataFrame, today: Column) -> DataFrame:
    """dataset, newest, age, problems of data sets (dataset, newest, stale_days, inclusive, source), one row each, and their runs (dataset, day, status).

    Problems, in order: no data; stale (age above stale_days, or equal where inclusive); fallback, where the source is a
    fallback that carried the newest period on an earlier day and the last run failed; no status, where there was no run.
    """
    last = runs.groupBy("dataset").agg(F.max_by("status", "day").alias("status"), F.max("day").alias("ran"))
    rows = datasets.join(last, "dataset", "left").withColumn("age", F.datediff(today, "newest"))
    stale = (F.col("age") > F.col("stale_days")) | (F.col("inclusive") & (F.col("age") == F.col("stale_days")))
    held = (F.col("source") == "fallback") & (F.col("ran") > F.col("newest")) & (F.col("status") == "failed")
    problems = F.array_compact(F.array(F.when(F.col("newest").isNull(), "no data"), F.when(stale, "stale"), F.when(held, "fallback"), F.when(F.col("status").isNull(), "no status")))
    return rows.select("dataset", "newest", "age", problems.alias("problems"))


def big_moves(old: DataFrame, new: DataFrame, key: str, value: str, limit: float, allowed: DataFrame | None = None) -> DataFrame:
    """key, old, new, blocks: keys whose value moved by more than limit, both being numbers; those that allowed (key) names don't block."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key).where(F.abs(F.col("new") - F.col("old")) > limit)
    if allowed is None:
        return both.withColumn("blocks", F.lit(True))
    known = allowed.select(key).distinct().withColumn("_free", F.lit(True))
    return both.join(known, key, "left").select(key, "old", "new", F.col("_free").isNull().alias("blocks"))

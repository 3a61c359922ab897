"""Merging, joining, ranking and counting rows of price, tax and state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut


def replace_periods(existing: DataFrame, new: DataFrame, on: str = "period") -> DataFrame:
    """All rows of new, and those of existing whose period new doesn't have."""
    return new.unionByName(existing.join(new.select(on).distinct(), on, "left_anti"))


def first_by_precedence(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keyset_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: unknown (only in a), missing (only in b) or both."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "unknown").when(F.col("_a").isNull(), "missing").otherwise("both")
    return x.join(y, key, "full").select(key, side.alias("side"))


def content_equal(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row, equal: whether both hold the same rows, as often, without the ignored columns."""
    columns = [c for c in a.columns if c not in ignore]
    counted = a.select(*columns, F.lit(1).alias("_n")).unionAll(b.select(*columns, F.lit(-1).alias("_n"))).groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return counted.agg((F.count_if(F.col("_n") != 0) == 0).alias("equal"))


def fold_pins(pins: DataFrame, keys: list[str], direction: str, row: str, hints: str | None = None) -> DataFrame:
    """One row for pins with equal keys: rows (ids in order), the direction if all agree, else null, and all that their hints (an array) hold, in order."""
    seen = F.collect_set(F.coalesce(F.col(direction), F.lit("")))
    more = [] if hints is None else [F.array_sort(F.array_distinct(F.flatten(F.collect_set(hints)))).alias("hints")]
    folded = pins.groupBy(*keys).agg(seen.alias("_d"), F.sort_array(F.collect_list(row)).alias("rows"), *more)
    return folded.select(*keys, F.when(F.size("_d") == 1, F.nullif(F.col("_d")[0], F.lit(""))).alias("direction"), "rows", *(["hints"] if more else []))


def latest_prices(states: DataFrame, prices: DataFrame, key: str, on: str) -> DataFrame:
    """Every state, with its series' newest row or nulls."""
    fields = [c for c in prices.columns if c != key]
    last = prices.groupBy(key).agg(F.max_by(F.struct(*fields), on).alias("_p")).select(key, *(F.col(f"_p.{c}").alias(c) for c in fields))
    return states.join(last, key, "left")


def region_mates(states: DataFrame, code: str, series: str, region: str) -> DataFrame:
    """code, mate: others with the same series; for a state that is alone or has none, others of its region."""
    a, b = states.select(F.col(code), F.col(series).alias("_s"), F.col(region).alias("_r")), states.select(F.col(code).alias("mate"), F.col(series).alias("_t"), F.col(region).alias("_q"))
    same = a.join(b, (F.col("_s") == F.col("_t")) & (F.col(code) != F.col("mate"))).select(code, "mate")
    rest = a.join(same.select(code).distinct(), code, "left_anti").join(b, (F.col("_r") == F.col("_q")) & (F.col(code) != F.col("mate")))
    return same.union(rest.select(code, "mate"))


def competition_rank(rows: DataFrame, value: str, ranked: Column) -> DataFrame:
    """from_top, from_bottom and n_ranked; ties share a place; rows that aren't ranked have nulls.

    The places come from counts per distinct value, so one task sees distinct values, not rows.
    """
    counts = rows.where(ranked & F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(value), F.desc(value)))
    places = counts.select(F.col(value).alias("_v"), (1 + F.coalesce(F.sum("_c").over(down), F.lit(0))).alias("from_top"), (1 + F.coalesce(F.sum("_c").over(up), F.lit(0))).alias("from_bottom"), F.sum("_c").over(Window.partitionBy()).alias("n_ranked"))
    return rows.join(places, ranked & (F.col(value) == F.col("_v")), "left").drop("_v")


def count_by(dimension: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """n for every key of the dimension, 0 where no row has it."""
    return dimension.select(key).distinct().join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def direction_counts(moved: DataFrame, by: list[str], change: str) -> DataFrame:
    """Rows by direction, and the least and largest move up and down."""
    c, up, down = F.col(change), F.col(change) > 0, F.col(change) < 0
    return moved.groupBy(*by).agg(F.count_if(up).alias("up"), F.count_if(down).alias("down"), F.count_if(c == 0).alias("flat"), F.min(F.when(up, c)).alias("least_up"), F.max(F.when(up, c)).alias("most_up"), F.min(F.when(down, -c)).alias("least_down"), F.max(F.when(down, -c)).alias("most_down"))


def leaders(moved: DataFrame, by: list[str], change: str, name: str) -> DataFrame:
    """Rows tied for the largest move of each direction."""
    sign = F.signum(change).cast("int")
    ranked = moved.where(F.col(change) != 0).withColumn("sign", sign).withColumn("_r", F.rank().over(Window.partitionBy(*by, sign).orderBy(F.desc(F.abs(change)))))
    return ranked.where("_r = 1").groupBy(*by, "sign").agg(F.max(F.abs(change)).alias("move"), F.array_join(F.sort_array(F.collect_list(name)), ",").alias("names"))


def top_or_flagged(rows: DataFrame, n: int, order: list[Column], flag: Column) -> DataFrame:
    """The first n rows in order, and every other row with the flag."""
    top = rows.orderBy(*order).limit(n)
    return top.unionByName(rows.where(flag).exceptAll(top.where(flag)))


def newest_n(rows: DataFrame, on: str, n: int) -> DataFrame:
    """Rows of the newest n dates."""
    return rows.join(rows.select(on).distinct().orderBy(F.desc(on)).limit(n), on, "left_semi")


def largest_moves(old: DataFrame, new: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """Keys whose value moved by more than limit."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key)
    return both.where(F.abs(F.col("new") - F.col("old")) > limit)


def freshness(rows: DataFrame, dataset: str, on: str, today: Column, stale_from: int) -> DataFrame:
    """newest, age in days and stale for every dataset."""
    last = rows.groupBy(dataset).agg(F.max(on).alias("newest"))
    return last.select(dataset, "newest", F.datediff(today, "newest").alias("age")).withColumn("stale", F.coalesce(F.col("age") >= stale_from, F.lit(True)))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: rows that break each rule, all counted in one pass."""
    counted = rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(k) for k, ok in rules.items()))
    return counted.unpivot([], list(rules), "rule", "n")


def find_rows(rows: DataFrame, code: str, name: str, typed: str) -> DataFrame:
    """Rows whose code starts with the typed text or whose name holds it; hit: the exact one, or the only one."""
    q = typed.strip().lower()
    found = rows.where(F.lower(F.col(code).cast("string")).startswith(q) | F.lower(name).contains(q))
    alone = found.groupBy().agg((F.count("*") == 1).alias("_alone"))  # one row
    exact = (F.lower(name) == q) | (F.lower(F.col(code).cast("string")) == q)
    return found.crossJoin(F.broadcast(alone)).withColumn("hit", exact | F.col("_alone")).drop("_alone")


def attach_dimension(rows: DataFrame, dimension: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """rows with the columns of their dimension row; an unknown key is an error if strict."""
    joined = rows.join(dimension.withColumn("_known", F.lit(True)), key, "left")
    if strict:
        joined = joined.where(F.when(F.col("_known") | F.col(key).isNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))))
    return joined.drop("_known")


def last_two(rows: DataFrame, on: str) -> DataFrame:
    """One row, cur and prev: the newest date and the newest one before it."""
    recent = rows.select(on).distinct().orderBy(F.desc(on)).limit(2)
    return recent.agg(F.max(on).alias("cur"), F.when(F.count("*") == 2, F.min(on)).alias("prev"))


def join_snapshots(states: DataFrame, snapshots: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """Every state with cur and prev: its value in the newest snapshot and in the one before, and the days between them."""
    dates = F.broadcast(last_two(snapshots, on).withColumnsRenamed({"cur": "_c", "prev": "_p"}))
    near = snapshots.join(dates, F.col(on).isin(F.col("_c"), F.col("_p")))
    pair = near.groupBy(key).agg(F.max(F.when(F.col(on) == F.col("_c"), F.col(value))).alias("cur"), F.max(F.when(F.col(on) == F.col("_p"), F.col(value))).alias("prev"))
    return states.join(pair, key, "left").crossJoin(dates.select(F.datediff("_c", "_p").alias("gap")))


def next_door(states: DataFrame, adjacency: DataFrame, prices: DataFrame, key: str, price: str) -> DataFrame:
    """Per state its neighbours with a price and itself, cheapest first; the state itself first on ties, then by name."""
    pairs = adjacency.select(key, "mate").unionByName(states.select(key, F.col(key).alias("mate"))).distinct()
    known = states.join(prices.where(F.col(price).isNotNull()).select(key, price), key)
    mate = known.select(F.col(key).alias("mate"), F.col("name").alias("mate_name"), F.col("region").alias("_region"), F.col(price).alias("mate_price"))
    own = states.join(prices.select(key, price), key, "left").select(key, F.col("region").alias("_own"), F.col(price).alias("_price"))
    rows = pairs.join(mate, "mate").join(own, key)
    order = Window.partitionBy(key).orderBy("mate_price", (F.col(key) != F.col("mate")).cast("int"), "mate_name")
    return rows.select(key, F.row_number().over(order).alias("place"), "mate", "mate_price", (F.col("mate_price") - F.col("_price")).alias("diff"), F.when(~F.col("_region").eqNullSafe(F.col("_own")), F.col("_region")).alias("mate_region"))


def row_flags(cur, prev, gap, weekly, surveyed, move: float, apart: float):
    """Flags of a state's row in their fixed order: gap, large_move, eia_divergence, no_eia_survey, prev_missing."""
    rules = ((gap > 1, "gap"), (F.abs(cur - prev) >= move, "large_move"), (F.abs(cur - weekly) > apart, "eia_divergence"), (~surveyed, "no_eia_survey"), (cur.isNotNull() & prev.isNull(), "prev_missing"))
    return F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules)))


def check_snapshots(snapshots: DataFrame, known: DataFrame, key: str, on: str, value: str, low: float, high: float, move: float) -> DataFrame:
    """Per snapshot an outcome against the one before it: invalid (a key missing, unknown or twice, a value out of range, or nothing changed), else ok; and its warnings."""
    order = Window.partitionBy(key).orderBy(on)
    dates = Window.orderBy(on)  # over one row for each snapshot
    days = snapshots.select(on).distinct().withColumn("_before", F.lag(on).over(dates))
    flagged = snapshots.join(known.select(key).distinct().withColumn("_k", F.lit(1)), key, "left")
    rows = flagged.withColumn("_last", F.lag(F.struct(on, value)).over(order)).join(days, on)
    prev = F.when(F.col(f"_last.{on}") == F.col("_before"), F.col(f"_last.{value}"))
    v = F.col(value)
    per = rows.groupBy(on).agg(
        F.count("*").alias("n"), F.count_distinct(key).alias("_keys"), F.count("_k").alias("_known"), F.count_if(v.isNull() | ~v.between(low, high)).alias("_out"),
        F.bool_and(v.eqNullSafe(prev)).alias("_same"), F.max(F.datediff(on, "_before")).alias("_gap"), F.count_if(prev.isNull()).alias("_missing"), F.count_if(F.abs(v - prev) >= move).alias("_large"), F.max(F.col("_before").isNotNull()).alias("_has"))
    whole = per.crossJoin(F.broadcast(known.agg(F.count_distinct(key).alias("_all"))))
    bad = (F.col("n") != F.col("_all")) | (F.col("_keys") != F.col("n")) | (F.col("_known") != F.col("n")) | (F.col("_out") > 0) | (F.col("_same") & F.col("_has"))
    warn = F.array_compact(F.array(F.when(F.col("_gap") > 1, "gap"), F.when(F.col("_has") & (F.col("_missing") > 0), "prev_missing"), F.when(F.col("_large") > 0, "large_move")))
    return whole.select(on, "n", F.when(bad, "invalid").otherwise("ok").alias("outcome"), F.array_join(warn, ",").alias("warnings"))


def blank_regions(states: DataFrame, weekly: DataFrame, series: str, on: str, value: str) -> DataFrame:
    """Per region its members whose series has no value in the newest week of all."""
    newest = F.broadcast(weekly.agg(F.max(on).alias(on)))
    priced = weekly.join(newest, on).where(F.col(value).isNotNull()).select(series)
    gone = states.where(F.col(series).isNotNull()).join(priced, series, "left_anti")
    return gone.groupBy("region").agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("members"), F.count("*").alias("n"))


def merge_with_provenance(existing: DataFrame, primary: DataFrame, fallback: DataFrame, on: str) -> DataFrame:
    """existing with the weeks of primary, and those of fallback for weeks newer than primary's last; source tells which gave a row."""
    edge = F.broadcast(primary.agg(F.max(on).alias("_edge")))
    late = fallback.crossJoin(edge).where(F.col("_edge").isNull() | (F.col(on) > F.col("_edge"))).drop("_edge")
    new = primary.withColumn("source", F.lit("primary")).unionByName(late.withColumn("source", F.lit("fallback")))
    return replace_periods(existing.withColumn("source", F.lit("existing")), new, on)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with place, their position in the total order, without one task that sorts them all.

    The sort is by range; each partition's rows are counted and its start is the sum of the counts before it.
    The sorted rows are kept, so that both readers see the same partitions.
    """
    laid = cut(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % F.lit(2**33)))
    sizes = laid.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return laid.join(F.broadcast(starts.select("_p", "_s")), "_p").withColumn("place", F.col("_s") + F.col("_i") + 1).drop("_p", "_i", "_s")

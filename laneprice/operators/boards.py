"""What is said beside a price board: who moved most, how many moved which way, who is at a record, and who belongs to what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import signed_cents
from ..functions.text import squash

#: Names that a note gives one by one; where more are tied it counts them.
NAMED = 3


def listed(names: Column) -> Column:
    """An array of names as words: a; a and b; a, b and c. Null for none."""
    n = F.size(names)
    return F.when(n == 1, names[0]).when(n > 1, F.concat(F.array_join(F.slice(names, 1, n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def _sign(change: Column, flat_below: int) -> Column:
    return F.when(F.abs(change) < flat_below, 0).otherwise(F.signum(change)).cast("int")


def movers(moved: DataFrame, by: list[str], change: str, name: str, flat_below: int = 1) -> DataFrame:
    """by, sign, place, name, change, tied, leads, trails: rows that moved by flat_below or more, each direction biggest first, ties by name.

    tied counts the rows of one direction with the same move. leads: tied for the biggest. trails: tied for the smallest
    where all rows with a change went one way and not all moved alike.
    """
    rows = moved.where(F.col(change).isNotNull()).select(*by, F.col(name).alias("name"), F.col(change).alias("change")).withColumn("sign", _sign(F.col("change"), flat_below)).withColumn("_size", F.abs("change"))
    alike = rows.groupBy(*by, "sign", "_size").agg(F.count("*").alias("tied"))  # from here on one row for each size of a move
    way, whole = Window.partitionBy(*by, "sign"), Window.partitionBy(*by)
    alike = alike.withColumn("_top", F.max("_size").over(way)).withColumn("_least", F.min("_size").over(way)).withColumn("_ways", F.max("sign").over(whole) - F.min("sign").over(whole))
    told = alike.where("sign <> 0").select(*by, "sign", "_size", "tied", (F.col("_size") == F.col("_top")).alias("leads"), ((F.col("_ways") == 0) & (F.col("_size") == F.col("_least")) & (F.col("_least") < F.col("_top"))).alias("trails"))
    place = F.row_number().over(way.orderBy(F.desc("_size"), "name"))
    found = rows.where("sign <> 0").withColumn("place", place).join(told, [*by, "sign", "_size"])
    return found.select(*by, "sign", "place", "name", "change", "tied", "leads", "trails")


def biggest_note(moved: DataFrame, by: list[str], change: str, name: str, flat_below: int = 1) -> DataFrame:
    """by, head, text: who moved most each way and, where all went one way, who moved least; up to NAMED by name, more by number.

    Groups in which nothing moved have no row.
    """
    ends = movers(moved, by, change, name, flat_below).where("leads OR trails")
    few = F.sort_array(F.collect_list(F.when(F.col("tied") <= NAMED, F.col("name"))))  # NAMED names at most
    who = ends.groupBy(*by, "sign", "leads", "trails", "change").agg(F.max("tied").alias("_n"), few.alias("_names"))
    said = F.concat(F.when(F.col("_n") > NAMED, F.concat(F.col("_n").cast("string"), F.lit(" tied"))).otherwise(listed(F.col("_names"))), F.lit(", "), signed_cents(F.col("change")), F.lit("."))
    pick = lambda rule: F.max(F.when(rule, F.col("_said")))
    up, down = F.col("leads") & (F.col("sign") > 0), F.col("leads") & (F.col("sign") < 0)
    parts = who.withColumn("_said", said).groupBy(*by).agg(pick(up).alias("_up"), pick(down).alias("_down"), pick(F.col("trails")).alias("_least"))
    fall = F.when(F.col("_up").isNull(), F.col("_down")).otherwise(F.concat(F.lit("Biggest fall. "), F.col("_down")))
    head = F.when(F.col("_up").isNotNull(), "Biggest rise.").otherwise("Biggest fall.")
    return parts.select(*by, head.alias("head"), F.concat_ws(" ", "_up", fall, F.concat(F.lit("Smallest, "), F.col("_least"))).alias("text"))


def key_line(moved: DataFrame, by: list[str], change: str, noun: str, flat_below: int = 1, apart: Column | None = None, apart_name: str = "DC") -> DataFrame:
    """by, line: one sentence on how many rose, fell and stayed about the same, with the range of the moves where all went one way.

    apart tells rows that aren't counted as a noun but by their own name, at most one a group.
    """
    c = F.col(change)
    sign = _sign(c, flat_below)
    apart = F.lit(False) if apart is None else F.coalesce(apart, F.lit(False))
    per = [x for k, s in (("up", 1), ("down", -1), ("flat", 0)) for x in (F.count_if(sign == s).alias(f"n_{k}"), F.count_if((sign == s) & apart).alias(f"a_{k}"))]
    found = moved.where(c.isNotNull()).groupBy(*by).agg(*per, F.count("*").alias("n"), F.count_if(apart).alias("a"), F.min(F.abs(c)).alias("lo"), F.max(F.abs(c)).alias("hi"))

    def many(k: str, first: Column | bool) -> Column:
        n, a = F.col(f"n{k}"), F.col(f"a{k}")
        alone = F.when(F.lit(first) if isinstance(first, bool) else first, plural(n, noun)).otherwise(n.cast("string"))
        return F.when(a == 0, alone).when(n == a, apart_name).otherwise(F.concat(plural(n - a, noun), F.lit(f" and {apart_name}")))

    cents = lambda x: F.concat(F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"), F.lit("¢"))
    spread = F.when(F.col("lo") == F.col("hi"), F.concat(F.lit(" "), cents(F.col("lo")))).otherwise(F.concat(F.lit(", "), cents(F.col("lo")), F.lit(" to "), cents(F.col("hi"))))
    every = F.when(F.col("n") == 1, F.when(F.col("a") == 1, apart_name).otherwise(f"The one {noun}")).otherwise(F.concat(F.lit("All "), many("", True)))
    was = lambda k: F.when(F.col(f"n{k}") == 1, " was about the same").otherwise(" were about the same")
    parts = F.array_compact(F.array(
        F.when(F.col("n_up") > 0, F.concat(many("_up", True), F.lit(" rose"))), F.when(F.col("n_down") > 0, F.concat(many("_down", F.col("n_up") == 0), F.lit(" fell"))),
        F.when(F.col("n_flat") > 0, F.concat(many("_flat", (F.col("n_up") == 0) & (F.col("n_down") == 0)), was("_flat")))))
    line = F.when(F.col("n_up") == F.col("n"), F.concat(every, F.lit(" rose"), spread)).when(F.col("n_down") == F.col("n"), F.concat(every, F.lit(" fell"), spread)).when(F.col("n_flat") == F.col("n"), F.concat(every, was(""))).otherwise(listed(parts))
    return found.select(*by, F.concat(line, F.lit(".")).alias("line"))


def record_note(kinds: DataFrame, by: list[str], kind: str, name: str, noun: str, since: str) -> DataFrame:
    """by, records, n, note: which rows are at a record; all of them in one phrase, up to NAMED by name, more by number. No row at a record: null."""
    at = F.col(kind) == "record"
    first = Window.partitionBy(*by).orderBy(F.when(at, 0).otherwise(1), name)
    rows = kinds.withColumn("_r", F.row_number().over(first))
    # One more name than are said, so the array stays small whatever the group.
    found = rows.groupBy(*by).agg(F.count_if(at).alias("records"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(at & (F.col("_r") <= NAMED), F.col(name)))).alias("_names"))
    r, n, tail = F.col("records"), F.col("n"), f"in our records, which start {since}."
    note = (
        F.when(r == 0, None)
        .when(r == n, f"Every {noun} is at its highest price {tail}")
        .when(r == 1, F.concat(F.col("_names")[0], F.lit(f" is at its highest price {tail}")))
        .when(r <= NAMED, F.concat(listed(F.col("_names")), F.lit(f" are at their highest prices {tail}")))
        .otherwise(F.concat(r.cast("string"), F.lit(" of the "), n.cast("string"), F.lit(f" {noun}s are at their highest prices {tail}")))
    )
    return found.select(*by, "records", "n", note.alias("note"))


def region_members(states: DataFrame, region: str, code: str, apart: Column) -> DataFrame:
    """region, members (codes in order), n (without those apart), has_apart, covers (in words) and largest: most members, the first region on ties."""
    s = states.where(F.col(region).isNotNull())
    found = s.groupBy(region).agg(F.array_join(F.sort_array(F.collect_list(code)), ",").alias("members"), F.count("*").alias("_all"), F.count_if(~apart).alias("n"), F.bool_or(apart).alias("has_apart"))
    most = found.agg(F.max("_all").alias("_all"))
    first = found.join(F.broadcast(most), "_all", "left_semi").agg(F.min(region).alias("_b"))  # one row
    return found.crossJoin(F.broadcast(first)).select(region, "members", "n", "has_apart", covers(F.col("n"), F.col("has_apart")).alias("covers"), (F.col(region) == F.col("_b")).alias("largest"))


def covers(n: Column, apart: Column, noun: str = "state", apart_name: str = "DC") -> Column:
    """How many of a noun, and the one that is counted apart: 15 states and DC; DC; no states."""
    return F.when((n == 0) & apart, apart_name).when(n == 0, f"no {noun}s").otherwise(F.concat(plural(n, noun), F.when(apart, f" and {apart_name}").otherwise("")))


def join_current(states: DataFrame, taxes: DataFrame, key: str, value: str, out_of_date: str) -> DataFrame:
    """Every state with the value of its tax row, null where it has none or it is out of date."""
    return states.join(taxes.select(key, F.when(~F.col(out_of_date), F.col(value)).alias(value)), key, "left")


def hint_check(rows: DataFrame, by: list[str], hints: str, found: str) -> DataFrame:
    """by, checkable, mismatches: rows with hints, and those whose found key is none of them."""
    some = rows.where(F.size(F.coalesce(hints, F.array())) > 0)
    return some.groupBy(*by).agg(F.count("*").alias("checkable"), F.count_if(~F.coalesce(F.array_contains(hints, F.col(found)), F.lit(False))).alias("mismatches"))


def national_average(daily: DataFrame, by: list[str], units: str) -> DataFrame:
    """by, average: mean of ten-thousandths, to the nearest thousandth of a dollar, halves up."""
    return daily.groupBy(*by).agg(F.round(F.floor(F.avg(units) / 10 + 0.5) / 1000, 3).alias("average"))


def places(rows: DataFrame, states: DataFrame, top: int, codes: tuple[str, ...], capitals: tuple[str, ...], strict: bool = True) -> DataFrame:
    """id, name, state, lat, lon, population, capital, place: the top places by population and every capital, largest first.

    rows: id, name, code (of its kind), country, state, lat, lon, population as text. Only places of the country US, of a
    known state (states: state) and kind, with a position and people count. Ties go by name, state, lat and lon, then
    id. If strict, a state without a capital is an error that names all such states.
    """
    p = eligible_places(rows, states, codes).withColumn("capital", F.col("code").isin(*capitals)).drop("code")
    order = [F.desc("population"), *(F.col(c) for c in ("name", "state", "lat", "lon", "id"))]
    first = p.orderBy(*order).limit(top)  # sorted heads of the partitions, no sort of all rows
    kept = first.unionByName(p.where("capital").join(first.select("id"), "id", "left_anti"))
    if strict:
        lack = states.select("state").distinct().join(p.where("capital").select("state"), "state", "left_anti")
        message = lack.agg(F.array_join(F.sort_array(F.collect_list("state")), ", ").alias("_lack"))  # one row; states are few
        kept = kept.crossJoin(F.broadcast(message)).where(F.when(F.col("_lack") == "", True).otherwise(F.raise_error(F.concat(F.lit("no capital for "), F.col("_lack"))).cast("boolean"))).drop("_lack")
    return kept.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over top rows and a capital or so for each state


def eligible_places(rows: DataFrame, states: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """The rows that places chooses from, with numbers for lat, lon and population and trimmed names."""
    number = {"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "population": F.col("population").try_cast("long")}
    us = rows.where((F.col("country") == "US") & F.col("code").isin(*codes)).withColumns(number).where("lat IS NOT NULL AND lon IS NOT NULL AND population > 0")
    return us.join(F.broadcast(states.select("state").distinct()), "state", "left_semi").select("id", F.trim("name").alias("name"), "code", "state", "lat", "lon", "population")


def place_funnel(rows: DataFrame, states: DataFrame, top: int, codes: tuple[str, ...], capitals: tuple[str, ...]) -> DataFrame:
    """One row: us_rows, eligible, top, places, capitals_added and capitals of places()."""
    seen = rows.agg(F.count_if(F.col("country") == "US").alias("us_rows"))
    able = eligible_places(rows, states, codes).agg(F.count("*").alias("eligible"))
    kept = places(rows, states, top, codes, capitals, strict=False).agg(F.count("*").alias("places"), F.count_if("capital").alias("capitals"))
    one = seen.crossJoin(F.broadcast(able)).crossJoin(F.broadcast(kept))
    return one.select("us_rows", "eligible", F.least("eligible", F.lit(top).cast("long")).alias("top"), "places", (F.col("places") - F.least("eligible", F.lit(top).cast("long"))).alias("capitals_added"), "capitals")


def run_log(events: DataFrame, run: str, labels: dict[str, str]) -> DataFrame:
    """run, statuses, message, n_warnings of the events of update runs (run, source, status, changed, as_of, rebuilt, warning).

    statuses: source=status of each source's last event (by at), in order of the source. message: what each changed
    source of labels brought, in the order of labels; else that the result was rebuilt, else that nothing changed.
    """
    last = events.groupBy(run, "source").agg(F.max_by(F.struct("status", "changed", "as_of", "rebuilt"), F.struct("at", "id")).alias("e"), F.count("warning").alias("_w"))
    brought = [F.max(F.when((F.col("source") == s) & F.col("e.changed") & F.col("e.as_of").isNotNull(), F.concat(F.lit(f"{label} "), F.col("e.as_of").cast("string")))) for s, label in labels.items()]
    per = last.groupBy(run).agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "source", "e.status"))), ",").alias("statuses"), F.concat_ws("; ", *brought).alias("_parts"), F.coalesce(F.bool_or("e.rebuilt"), F.lit(False)).alias("_again"), F.sum("_w").alias("n_warnings"))
    message = F.when(F.col("_parts") != "", F.col("_parts")).when(F.col("_again"), "rebuilt").otherwise("no changes")
    return per.select(run, "statuses", message.alias("message"), "n_warnings")


def divergence(rows: DataFrame, key: str, a: str, b: str, apart: float) -> DataFrame:
    """key, diff and warning of rows whose two prices are more than apart from each other."""
    diff = F.col(a) - F.col(b)
    return rows.where(F.abs(diff) > apart).select(key, diff.alias("diff"), F.concat(F.col(key).cast("string"), F.when(diff > 0, " +").otherwise(" -"), F.format_string("%d", F.abs(diff))).alias("warning"))


def release_dates(existing: DataFrame, stored: DataFrame, primary: DataFrame, given: DataFrame, fallback: DataFrame, keys: list[str], on: str, value: str) -> DataFrame:
    """One row that goes with a merge of weeks: newest, source, release, next_release, warning.

    existing, primary and fallback are long tables (keys, on, value); primary counts if it has rows, else fallback is
    merged. stored and given are one row each (source, release, next_release): what came with existing and with
    primary. Given dates count only if primary's newest week is the newest of all, stored ones while their week still
    is. The source of a merge with the fallback stays the stored one if the newest week's values didn't change. The
    warning is cleared, where stored dates go without new ones, or missing, where primary gave none and stored stay.
    """
    top = lambda rows, name: rows.agg(F.max(on).alias(name))
    ends = top(existing, "_e").crossJoin(F.broadcast(top(primary, "_p"))).crossJoin(F.broadcast(top(fallback, "_f")))
    ends = ends.withColumn("newest", F.greatest("_e", F.when(F.col("_p").isNotNull(), F.col("_p")).otherwise(F.col("_f"))))
    edge = F.broadcast(ends.select("newest"))
    week = lambda rows, n: rows.join(edge, F.col(on) == F.col("newest")).select(*keys, F.col(value).alias("_v"), F.lit(n).alias("_n"))
    # Cells of the newest week that the fallback brings and existing doesn't hold alike, or holds and the fallback lacks; a week that the fallback lacks stays as it is.
    cells = week(fallback, 1).unionByName(week(existing, -1)).groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    moved = cells.agg(F.coalesce(F.bool_or(F.col("_n") != 0), F.lit(False)).alias("_moved"))
    one = ends.crossJoin(F.broadcast(moved)).join(F.broadcast(stored.select(*(F.col(c).alias(f"s_{c}") for c in ("source", "release", "next_release")))), F.lit(True), "left").join(F.broadcast(given.select(*(F.col(c).alias(f"g_{c}") for c in ("source", "release", "next_release")))), F.lit(True), "left")
    led, still, current = F.col("_p").isNotNull(), F.col("_e").eqNullSafe(F.col("newest")), F.col("_p") == F.col("newest")
    date = lambda c: F.coalesce(F.when(led & current, F.col(f"g_{c}")), F.when(still, F.col(f"s_{c}")))
    changed = F.col("_f").isNotNull() & (F.col("_f") == F.col("newest")) & F.col("_moved")
    source = F.when(led, F.col("g_source")).when(F.col("_e").isNotNull() & ~changed, F.col("s_source")).when(F.col("_f").isNotNull(), "fallback")
    rows = one.select("newest", source.alias("source"), date("release").alias("release"), date("next_release").alias("next_release"), F.col("s_release"), F.col("g_release"), led.alias("_led"))
    warning = F.when(F.col("release").isNull() & F.col("s_release").isNotNull(), "cleared").when(F.col("_led") & F.col("g_release").isNull() & F.col("release").isNotNull(), "missing")
    return rows.select("newest", "source", "release", "next_release", warning.alias("warning"))


def notes_check(notes: DataFrame, footnotes: DataFrame, rates: DataFrame, key: str, checked: str) -> DataFrame:
    """key, problem: hand-written notes that no longer go with their source, one row for each thing that is wrong.

    notes: key, anchor, period, out_of_date. footnotes: key, text. rates: key, out_of_date. lost: the footnotes of the key
    don't hold the anchor, whatever the case and blanks. period: the note is of another period than the checked one. out of
    date: note and rate don't say the same, or only one of them says that it is out of date.
    """
    held = notes.join(footnotes.select(key, F.col("text").alias("_text")), key, "left")
    found = held.groupBy(key, "anchor", "period").agg(F.coalesce(F.bool_or(F.contains(squash(F.col("_text")), squash(F.col("anchor")))), F.lit(False)).alias("_held"))
    lost = found.where(~F.col("_held")).select(key, F.lit("lost").alias("problem"))
    period = found.where(~F.col("period").eqNullSafe(F.lit(checked))).select(key, F.lit("period").alias("problem"))
    said = notes.where("out_of_date").select(key).distinct().withColumn("_a", F.lit(1)).join(rates.where("out_of_date").select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return lost.unionByName(period).unionByName(said.where("_a IS NULL OR _b IS NULL").select(key, F.lit("out of date").alias("problem"))).distinct()

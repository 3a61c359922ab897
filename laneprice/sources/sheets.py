"""Tables of cells (sheet, row, col, text): header rows, columns bound by name, values below labels, and tax tables made from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import cut

# Labels of a tax sheet, names that it writes otherwise, rows that don't count, and what stands where there is no date.
TAX_LABELS = {"name": "State", "rate": "DieselRate", "date": "DieselEffDate"}
ALIASES = {"DC": "District of Columbia"}
IGNORED = ("Puerto Rico",)
FEDERAL = "Federal Tax"
NO_DATE = ("-", "", "--")
#: Thousandths of a cent: the lowest and highest rate, and cents under which a rate is in dollars.
LOW, HIGH, DOLLARS = 5_000, 100_000, 1.5


class TaxTables(NamedTuple):
    rates: DataFrame
    federal: DataFrame
    rejects: DataFrame


def header_rows(cells: DataFrame, labels: list[str]) -> DataFrame:
    """sheet, head, at: the first row of each sheet that holds all labels, and the first column of each label."""
    named = cells.withColumn("text", F.trim("text")).where(F.col("text").isin(*labels))
    rows = named.groupBy("sheet", "row", "text").agg(F.min("col").alias("col")).groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("text", "col"))).alias("at"), F.count("*").alias("n"))
    return rows.where(F.col("n") == len(set(labels))).groupBy("sheet").agg(F.min("row").alias("head"), F.min_by("at", "row").alias("at"))


def bound_rows(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """sheet, row and columns (name: label): the texts under a sheet's header row, bound by its labels; null where there is no cell."""
    heads = header_rows(cells, list(columns.values()))
    below = cells.join(heads, "sheet").where(F.col("row") > F.col("head"))
    return below.groupBy("sheet", "row").agg(*(F.max(F.when(F.col("col") == F.try_element_at("at", F.lit(label)), F.trim("text"))).alias(name) for name, label in columns.items()))


def value_below(cells: DataFrame, label: str, required: bool = True) -> DataFrame:
    """sheet, value: the text right below the first cell that reads as label and has one; a sheet without any is an error if required, else null."""
    marks = cells.where(F.trim("text") == label).select("sheet", F.col("row").alias("_row"), "col")
    under = cells.where(F.trim("text") != "").select("sheet", (F.col("row") - 1).alias("_row"), "col", F.trim("text").alias("value"))
    found = marks.join(under, ["sheet", "_row", "col"]).groupBy("sheet").agg(F.min_by("value", F.struct("_row", "col")).alias("value"))
    out = cells.select("sheet").distinct().join(found, "sheet", "left")
    if not required:
        return out
    missing = F.raise_error(F.concat(F.lit(f"no value under {label} on sheet "), F.col("sheet").cast("string")))
    return out.withColumn("value", F.when(F.col("value").isNull(), missing).otherwise(F.col("value")))


def sheet_date(text: Column, latest_year: Column | None = None) -> Column:
    """A date written as m/d/yyyy, m/d/yy or yyyy-mm-dd, else null; of two digits a year after latest_year is one of the 1900s."""
    part = lambda k: F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$", k).try_cast("int")
    short = part(3) + 2000
    if latest_year is not None:
        short = F.when(short > latest_year, short - 100).otherwise(short)
    year = F.when(part(3) < 100, short).otherwise(part(3))
    written = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part(1).cast("string"), 2, "0"), F.lpad(part(2).cast("string"), 2, "0"))
    return F.coalesce(F.try_to_date(F.when(part(3).isNotNull(), written), "yyyy-MM-dd"), F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), "yyyy-MM-dd"))


def import_taxes(cells: DataFrame, states: DataFrame, low: int = LOW, high: int = HIGH) -> TaxTables:
    """Tax tables of sheets of cells: rates (sheet, code, mils, effective, dollars), federal (sheet, mils) and rejects (sheet, row, name, reason).

    Rows are found by the labels of the header row; names go by ALIASES, IGNORED ones are passed over, the federal row
    is apart. A rate under DOLLARS is dollars and becomes cents before it is rounded half up to thousandths. A rate of 0
    with no date is no rate (mils null). states: name, code; small. A sheet whose header, year, date, federal row or
    states are missing is told of once for each; a row that breaks a rule is left out of rates and told of.
    """
    when = value_below(cells, "CurrDate", False).select("sheet", sheet_date(F.col("value")).alias("published"))
    year = value_below(cells, "CurrYear", False).select("sheet", F.when(F.col("value").rlike(r"^\d{4}$"), F.col("value")).alias("year"))
    heads = header_rows(cells, list(TAX_LABELS.values())).select("sheet", "head")
    sheets = when.join(year, "sheet").join(heads, "sheet", "left")

    alias = F.coalesce(*(F.when(F.col("name") == a, b) for a, b in ALIASES.items()), F.col("name"))
    rows = cut(bound_rows(cells, TAX_LABELS)).where("name <> ''").withColumn("name", alias).where(~F.col("name").isin(*IGNORED))
    rows = rows.join(when, "sheet").join(F.broadcast(states.select("name", "code")), "name", "left")  # a row for each state
    once = rows.groupBy("sheet", "name").agg(F.count("*").alias("times"), F.min("row").alias("first"))
    rows = rows.join(once, ["sheet", "name"])
    date, federal = F.coalesce("date", F.lit("")), F.col("name") == FEDERAL
    rate = F.col("rate").try_cast("decimal(20,8)")
    mils = F.floor(F.when((rate < DOLLARS) & ~federal, rate * 100).otherwise(rate) * 1000 + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    effective = sheet_date(date, F.year("published"))
    none = (rate == 0) & date.isin(*NO_DATE) & ~federal
    reason = (
        F.when((F.col("times") > 1) & (F.col("row") > F.col("first")) & (F.col("code").isNotNull() | federal), "twice")
        .when(F.col("code").isNull() & ~federal, "unknown state")
        .when(F.coalesce("rate", F.lit("")) == "", "empty rate")
        .when(rate.isNull(), "not a number")
        .when((rate < 0) & ~federal, "negative")
        .when((rate == 0) & ~none & ~federal, "zero with a date")
        .when(~none & ~federal & effective.isNull(), "not a date")
        .when(~none & ~federal & (effective > F.col("published")), "after the table was made")
        .when(~none & ~mils.between(low, high), "out of band")
    )
    judged = rows.select("sheet", "row", "name", "code", F.when(~none, mils).alias("mils"), F.when(~none & ~federal, effective).alias("effective"), ((rate < DOLLARS) & (rate > 0)).alias("dollars"), federal.alias("federal"), reason.alias("reason"))
    judged = cut(judged)
    good = judged.where("reason IS NULL")

    named = good.groupBy("sheet").agg(F.collect_set("code").alias("codes"), F.bool_or("federal").alias("federal"))
    # A state that has a broken row isn't missing as well.
    told = rows.groupBy("sheet").agg(F.collect_set("code").alias("told"))
    every = states.agg(F.collect_set("code").alias("every"))  # one row
    whole = sheets.join(named, "sheet", "left").join(told, "sheet", "left").crossJoin(F.broadcast(every))
    wants = F.when(F.col("head").isNotNull(), F.array_except("every", F.coalesce("told", F.array().cast(every.schema["every"].dataType))))
    gaps = F.array(
        F.when(F.col("head").isNull(), "no header row"), F.when(F.col("published").isNull(), "no date"), F.when(F.col("year").isNull(), "no year"),
        F.when(F.col("head").isNotNull() & ~F.coalesce("federal", F.lit(False)), "no federal row"),
    )
    lost = lambda name, why: (F.lit(None).cast(rows.schema["row"].dataType).alias("row"), name.alias("name"), why.alias("reason"))
    of_sheets = whole.select("sheet", F.explode(F.array_compact(gaps)).alias("why")).select("sheet", *lost(F.lit(None).cast("string"), F.col("why")))
    of_states = whole.select("sheet", F.explode(wants).alias("code")).select("sheet", *lost(F.col("code").cast("string"), F.lit("missing state")))
    rejects = judged.where("reason IS NOT NULL").select("sheet", "row", "name", "reason").unionByName(of_sheets).unionByName(of_states)
    return TaxTables(good.where("NOT federal").select("sheet", "code", "mils", "effective", "dollars"), good.where("federal").select("sheet", "mils"), rejects)

"""Integer money, its words and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_units(price: Column) -> Column:
    """Dollars to ten-thousandths, halves up."""
    return F.floor(price * 10000 + 0.5)


def to_mills(units: Column) -> Column:
    """Ten-thousandths to thousandths, halves away from zero."""
    return (F.signum(units) * F.floor((F.abs(units) + 5) / 10)).cast("long")


def format_price(mills: Column) -> Column:
    return F.concat(F.lit("$"), F.floor(mills / 1000).cast("string"), F.lit("."), F.lpad((mills % 1000).cast("string"), 3, "0"))


def signed_cents(mills: Column) -> Column:
    """Tenths of a cent with a sign; the minus is U+2212."""
    sign = F.when(mills > 0, "+").when(mills < 0, "−").otherwise("")
    return F.concat(sign, F.floor(F.abs(mills) / 10).cast("string"), F.lit("."), (F.abs(mills) % 10).cast("string"), F.lit("¢"))


def ordinal(n: Column) -> Column:
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def bin_change(mills: Column, edges: tuple[int, int, int]) -> Column:
    """0 for less than the first edge, up to 3 from the last edge on, with the sign of the change; null stays null."""
    size = F.when(F.abs(mills) < edges[0], 0).when(F.abs(mills) < edges[1], 1).when(F.abs(mills) < edges[2], 2).when(mills.isNotNull(), 3)
    return (F.signum(mills) * size).cast("int")


def per_mile_tenths(price_mills: Column, base_mills: Column, mpg: Column) -> Column:
    """Surcharge in tenths of a cent a mile: what the price is over the base, by miles a gallon, to the nearest."""
    over = price_mills - base_mills
    return F.when(price_mills.isNull() | base_mills.isNull() | mpg.isNull() | (mpg == 0), None).when(over <= 0, 0).otherwise(F.floor(over / mpg + 0.5 + 1e-9))


def _size(mills: Column) -> Column:
    """Tenths of a cent as cents, as dollars from one dollar on."""
    a = F.abs(mills)
    return F.when(a >= 1000, format_price(a)).otherwise(F.concat(F.floor(a / 10).cast("string"), F.lit("."), (a % 10).cast("string"), F.lit("¢")))


def change_words(mills: Column) -> Column:
    """Up or Down and by how much; No change for none."""
    return F.when(mills == 0, "No change").otherwise(F.concat(F.when(mills > 0, "Up ").otherwise("Down "), _size(mills)))


def diff_words(mills: Column) -> Column:
    """One price against another: less, more or Same price."""
    return F.when(mills == 0, "Same price").otherwise(F.concat(_size(mills), F.when(mills < 0, " less").otherwise(" more")))


def change_verb(mills: Column) -> Column:
    a = F.abs(mills)
    cents = F.concat(F.floor(a / 10).cast("string"), F.lit("."), (a % 10).cast("string"), F.lit("¢"))
    return F.when(mills == 0, "held steady").otherwise(F.concat(F.when(mills > 0, "rose ").otherwise("fell "), cents))


def tax_text(mils: Column) -> Column:
    """Thousandths of a cent as cents with the decimals there are, one at least."""
    frac = F.regexp_replace(F.lpad((F.abs(mils) % 1000).cast("string"), 3, "0"), "0+$", "")
    return F.concat(F.when(mils < 0, "−").otherwise(""), F.floor(F.abs(mils) / 1000).cast("string"), F.lit("."), F.when(frac == "", "0").otherwise(frac), F.lit("¢"))


def hours_text(hours: Column) -> Column:
    """Hours and minutes in words, to the nearest five minutes and five at least."""
    m = F.greatest(F.lit(5), F.floor(hours * 12 + 0.5) * 5).cast("long")
    h, rest = F.floor(m / 60), m % 60
    return F.concat_ws(" ", F.when(h > 0, F.concat(h.cast("string"), F.when(h == 1, " hour").otherwise(" hours"))), F.when(rest > 0, F.concat(rest.cast("string"), F.lit(" minutes"))))

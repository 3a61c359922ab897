"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

A source's rate is its target share of all text over its own share. Each document's number of copies is
the hash-seeded Poisson variate with that mean: the cumulative distribution is inverted at a number in
[0, 1) that the document's id and the seed decide. Copies are then shuffled globally by a second hash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import repeated, unused

#: Sources, and steps of all their distributions, up to which the rates are broadcast.
BROADCAST_SOURCES, BROADCAST_STEPS = 10_000, 1_000_000
#: Parts that a source is dealt into for the join otherwise.
SALTS = 256
#: A source's documents can't be repeated more often than this on average.
MOST_RATE = float(1 << 30)
#: Standard deviations, and counts besides, around a rate that its distribution is worked out for.
DEVIATIONS, BESIDES = 8, 20


def uniform(*parts) -> F.Column:
    """A number in [0, 1) with 52 random bits, from the strings."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """rates (source, rate) with low and cdf: P(X <= k) for k from low to where the rest is below 1e-13.

    low is 0 for rates up to 100. Beyond it is so far below the rate that less than 1e-13 lies there, so a
    table has 16 steps for each standard deviation and is short for large rates as well.
    """
    reach = DEVIATIONS * F.sqrt("rate") + BESIDES
    bounded = rates.withColumn("low", F.when(F.col("rate") > 100, F.floor(F.col("rate") - reach)).otherwise(0).cast("long"))
    steps = bounded.withColumn("k", F.explode(F.sequence("low", F.ceil(F.col("rate") + reach).cast("long"))))
    sofar = Window.partitionBy("source").orderBy("k")
    # From low on, probabilities follow each other by the factor rate / k; where low is 0 the first one is exp(-rate).
    log = F.sum(F.when(F.col("k") > F.col("low"), F.ln(F.col("rate") / F.col("k"))).otherwise(0.0)).over(sofar)
    factorial = F.sum(F.when(F.col("k") > 1, F.ln("k")).otherwise(0.0)).over(sofar)
    small = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - factorial)).otherwise((F.col("k") == 0).cast("double"))
    p = steps.withColumn("p", F.when(F.col("low") > 0, F.exp(log)).otherwise(small))
    whole = F.when(F.col("low") > 0, F.sum("p").over(Window.partitionBy("source"))).otherwise(1.0)
    each = p.select("source", "rate", "low", "k", (F.sum("p").over(sofar) / whole).alias("c"))
    return each.groupBy("source", "rate", "low").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, source_col: str, text_col: str) -> DataFrame:
    mass = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)) + 1).alias("mass"))
    if weights is None:
        mass = mass.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "name string, weight double")
        mass = mass.join(F.broadcast(given), F.expr("source <=> name"), "left").select("source", "mass", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    whole = mass.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))  # one row
    return mass.crossJoin(F.broadcast(whole)).select("source", F.coalesce(F.try_divide(F.col("weight") * F.col("all_mass"), F.col("all_weight") * F.col("mass")), F.lit(0.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """docs, each row as often as its Poisson number says, in a global random order, with copy and mix_key.

    weights: target share of the text by source, in any unit; None: equal shares. A source that isn't named
    gets none; negative and non-finite weights are refused, and weights that are all zero give no rows. A
    null source is a source of its own. A document's mass is its characters and one more, so null and empty
    texts count as well. Rows that repeat an id draw the same number; null ids draw by text. Columns named
    copy or mix_key are replaced, others pass through whatever their names. The total mass is kept in
    expectation. A source so small that its documents would be repeated more than MOST_RATE times on
    average is an error.
    """
    if any(not math.isfinite(w) or w < 0 for w in (weights or {}).values()):
        raise ValueError("weights must be finite and not negative")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("copy", "mix_key")]
    source, low, cdf, name, own, salt, part, n = unused(docs.columns, "of_source", "low", "cdf", "name", "own", "salt", "part", "times")
    rates = source_rates(docs, weights, source_col, text_col)
    if (highest := rates.agg(F.max("rate")).first()[0] or 0) > MOST_RATE:
        raise ValueError(f"a source's documents would be repeated {highest:.3g} times")
    tables = poisson_tables(rates).select(F.col("source").alias(source), F.col("low").alias(low), F.col("cdf").alias(cdf))
    sources, steps = tables.agg(F.count("*"), F.coalesce(F.sum(F.size(cdf)), F.lit(0))).first()
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    keyed = docs.select(*columns, named.alias(name), F.col(source_col).cast("string").alias(own))
    same = F.col(own).eqNullSafe(F.col(source))
    if sources <= BROADCAST_SOURCES and steps <= BROADCAST_STEPS:
        drawn = keyed.join(F.broadcast(tables), same)
    else:
        salted = tables.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = keyed.withColumn(part, F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(part) == F.col(salt)))
    u = uniform(F.lit(f"copies {seed}"), F.col(name))
    below = F.col(low) + F.size(F.filter(cdf, lambda c: c <= u))
    counted = drawn.select(*columns, name, below.cast("long").alias(n)).where(F.col(n) > 0)
    copies = repeated(counted, n, "copy").withColumn("copy", F.col("copy").cast("int"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order {seed}"), name, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return copies.withColumn("mix_key", key).orderBy("mix_key", name, "copy").drop(name)

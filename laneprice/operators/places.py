"""Typed towns resolved to listed places by equi-joins on folded names and their beginnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .durable import cut

#: Words of the longest state name.
STATE_WORDS = 4


def _readings(queries: DataFrame, states: DataFrame, names: DataFrame) -> DataFrame:
    """qid, alone (the text is a state), turn, town, state: what a typed text may mean, in the order in which readings are tried."""
    folded = queries.select("qid", fold(F.col("q")).alias("t")).where("t <> ''")
    known = states.select(F.lower("code").alias("code"), F.lower("name").alias("state_name"))
    alone = known.select(F.explode(F.array("code", "state_name")).alias("t")).distinct().withColumn("alone", F.lit(True))
    rows = folded.join(F.broadcast(alone), "t", "left").withColumn("alone", F.coalesce("alone", F.lit(False)))  # two rows a state
    # A state's name at the end, the longest first, becomes its code.
    words = F.split("t", " ")
    tried = rows.where("NOT alone").select("qid", F.explode(_tails(words)).alias("state_name"))
    ends = tried.join(F.broadcast(known), "state_name").groupBy("qid").agg(F.max_by(F.struct("code", "state_name"), F.length("state_name")).alias("end"))
    rows = rows.join(ends, "qid", "left")
    before = F.regexp_replace(F.expr("left(t, length(t) - length(end.state_name))"), r",? $", "")
    named = F.when(F.col("end").isNotNull() & (before != ""), F.concat(before, F.lit(", "), F.col("end.code"))).otherwise(F.col("t"))
    rows = rows.withColumn("read", F.regexp_replace(named, r",? ([a-z]{2})$", ", $1"))
    listed = names.select(F.col("name").alias("t"), F.lit(True).alias("listed")).distinct()
    rows = rows.join(listed, "t", "left")
    once = (F.col("read") == F.col("t")) | F.contains("t", F.lit(","))
    tries = F.when(once, F.array("read")).when(F.coalesce("listed", F.lit(False)), F.array("t")).otherwise(F.array("read", "t"))
    out = rows.select("qid", "alone", F.posexplode(tries).alias("turn", "text"))
    part = lambda n: F.get(F.split("text", ", "), F.lit(n))
    return out.select("qid", "alone", "turn", part(0).alias("town"), F.nullif(part(1), F.lit("")).alias("state"))


def _tails(words: Column) -> Column:
    """The last one to STATE_WORDS words, joined, without the whole text."""
    sizes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(STATE_WORDS), F.size(words) - 1)))
    return F.transform(sizes, lambda n: F.array_join(F.slice(words, -n, n), " "))


def resolve_places(queries: DataFrame, gazetteer: DataFrame, states: DataFrame) -> DataFrame:
    """qid, outcome (place, ask or none), ord of the listed place for every typed text (qid, q).

    gazetteer has ord, name and state, states has code and name and is small. A state at the end, by code or name,
    is read so, unless the whole text is a listed name or that reading finds nothing. Then count the town
    itself, New York City for New York, and names that begin so. One town, or a town of a given state, is the
    place; several give the first in the list's order to ask about. A state alone is asked about where a town has its
    name, and else finds nothing.
    """
    places = gazetteer.select("ord", fold(F.col("name")).alias("name"), F.lower("state").alias("state"))
    reads = cut(_readings(queries, states, places))
    each = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("state")), F.struct("state")))

    def found(keyed: DataFrame) -> DataFrame:
        """For each name and state, and each name in any state (null): how many places, and the first."""
        both = keyed.select("name", "ord", each.alias("s")).select("name", "ord", "s.state")
        return both.groupBy("name", "state").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))

    begins = places.withColumn("name", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.substring("name", 1, k))))

    def met(rows: DataFrame, town: Column, table: DataFrame, how: str) -> DataFrame:
        side = table.select(F.col("name").alias("_name"), F.col("state").alias("_state"), F.col("n").alias(f"n_{how}"), F.col("ord").alias(f"ord_{how}"))
        return rows.join(side, (town == F.col("_name")) & F.col("state").eqNullSafe(F.col("_state")), "left").drop("_name", "_state")

    exact = cut(found(places))
    rows = met(reads, F.col("town"), exact, "own")
    rows = met(rows, F.when(F.col("town") == "new york", F.lit("new york city")), exact, "city")
    rows = met(rows, F.when(~F.col("alone"), F.col("town")), found(begins), "start")
    own, city = F.col("n_own").isNotNull(), F.col("n_own").isNull() & F.col("n_city").isNotNull()
    n, at = F.coalesce("n_own", "n_city", "n_start"), F.when(own, F.col("ord_own")).when(city, F.col("ord_city")).otherwise(F.col("ord_start"))
    sure = (n == 1) | (F.col("state").isNotNull() & (own | city))
    asked = F.col("alone") & (F.col("town") != "new york")
    outcome = F.when(n.isNull(), None).when(asked | ~sure, "ask").otherwise("place")
    best = rows.withColumn("outcome", outcome).withColumn("ord", at).where("outcome IS NOT NULL").groupBy("qid").agg(F.min(F.struct("turn", "outcome", "ord")).alias("b"))
    return queries.select("qid").join(best, "qid", "left").select("qid", F.coalesce("b.outcome", F.lit("none")).alias("outcome"), F.col("b.ord").alias("ord"))

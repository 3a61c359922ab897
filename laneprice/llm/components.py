"""Connected components by repeated hooking on the smaller neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a long, b long).

    Each round hooks a component on its smallest neighbour and follows hooks once more; edges inside a
    component disappear. Labels should be hashes: their random order makes the rounds logarithmic.
    Links with a null end and loops are ignored.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        # Written first: many may hook on one, and a join of written tables can be split where an aggregate's can't.
        hooks = cut(edges.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("from"), "to"))
        again = hooks.select(F.col("from").alias("to"), F.col("to").alias("next"))
        hooks = cut(hooks.join(again, "to", "left").select("from", F.coalesce("next", "to").alias("to")))

        def moved(df: DataFrame, column: str) -> DataFrame:
            return df.join(hooks.withColumnRenamed("from", column), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

        labels = cut(moved(labels, "component"))
        ends = moved(moved(edges, "a"), "b").where("a <> b")
        edges = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels.select("node", "component")

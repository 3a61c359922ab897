"""Arriving price files and events: upserts, moves and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import relations, series
from ..operators.durable import cut
from ..sources.sinks import bucket_of, mark, marked, read_buckets, write_buckets

#: Buckets of a table that streams keep.
BUCKETS = 64


def newest_version(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version for each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("_r")).select("_r.*")


def upsert_stream(source: DataFrame, target: str, keys: list[str], version: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Brings all that has arrived into target, the highest version of each key; a batch that changes nothing writes nothing.

    target is kept in buckets by the hash of the keys. A batch reads the buckets that its keys are in and rewrites
    those alone in which one of its rows is newer than the row there; of equal versions the one there stays. A
    ledger of batches beside the buckets lets one that runs again after a failure pass.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, done = batch.sparkSession, f"batch-{number}"
        if marked(spark, target, done):
            return
        rows = cut(newest_version(batch, keys, version).withColumn("bucket", bucket_of(keys, buckets)))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most buckets
        old = read_buckets(spark, target, rows.schema, touched)
        both = old.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True)))
        best = cut(both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), F.struct(version, ~F.col("_new"))).alias("_r")).select("_r.*"))
        changed = [r["bucket"] for r in best.where("_new").select("bucket").distinct().collect()]
        if changed:
            write_buckets(spark, {target: best.drop("_new")}, changed, done)
        else:
            mark(spark, target, done)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def move_stream(source: DataFrame, state: str, out: str, key: str, on: str, value: str, checkpoint: str, weekly: DataFrame | None = None, move: float = 5000, apart: float = 10_000, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the newest two values of every key in state and writes each key's move, gap in days and flags to out as values arrive.

    Flags are those of row_flags() at move and apart. weekly (key, weekly in the unit of value) holds the keys
    that the weekly survey has; without it no key is held against the survey. A row that arrives again is folded into
    the one with its key and date, so a batch may run again. Both tables are kept in buckets by the hash of the
    key; a batch reads and rewrites the buckets of its own keys, of both tables or of neither.
    """

    def fold(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.groupBy(key, on).agg(F.max(value).alias(value)).withColumn("bucket", bucket_of([key], buckets)))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most buckets
        if not touched:
            return
        old = read_buckets(spark, state, rows.schema, touched)
        once = old.unionByName(rows).groupBy("bucket", key, on).agg(F.max(value).alias(value))
        last = cut(once.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(on)))).where("_n <= 2").drop("_n").select(*rows.columns))
        changed = [r["bucket"] for r in last.exceptAll(old.select(*rows.columns)).select("bucket").distinct().collect()]
        if not changed:
            return
        moved = series.weekly_move(series.gap_days(last.drop("bucket"), [key], on), [key], on, value, ("gap",))
        if weekly is None:
            moved = moved.withColumn("weekly", F.lit(None).cast("double")).withColumn("surveyed", F.lit(True))
        else:
            known = weekly.select(F.col(key).alias("_key"), "weekly", F.lit(True).alias("surveyed"))
            moved = moved.join(known, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").fillna(False, ["surveyed"])
        flags = relations.row_flags(F.col(value), F.col("prev"), F.col("gap"), F.col("weekly"), F.col("surveyed"), move, apart)
        write_buckets(spark, {state: last, out: moved.withColumn("flags", flags).drop("weekly", "surveyed").withColumn("bucket", bucket_of([key], buckets))}, changed)

    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def freshness_stream(source: DataFrame, dataset: str, at: str, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """dataset, window, newest, n: the newest arrival in each window; rows later than `late` are left out."""
    return source.withWatermark(at, late).groupBy(F.window(at, every), dataset).agg(F.max(at).alias("newest"), F.count("*").alias("n"))


def read_arrivals(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stale(newest: Column, today: Column, days: int) -> Column:
    return F.coalesce(F.datediff(today, newest) >= days, F.lit(True))

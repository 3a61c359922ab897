"""Writers: validated together, only when changed, with stamps kept, and rejects."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import content_equal, violations


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _renamed(fs, source, target) -> bool:
    """Whether a rename went well; some file systems raise where others say no."""
    from py4j.protocol import Py4JJavaError

    try:
        return fs.rename(source, target)
    except Py4JJavaError:
        return False


def recover(spark: SparkSession, path: str) -> None:
    """Puts a folder back that was set aside by a swap that never ended; of several the one set aside last."""
    fs, make = _fs(spark, path)
    if fs.exists(make(path)) or not fs.exists(make(path).getParent()):
        return
    name = make(path).getName()
    aside = sorted((x.getModificationTime(), x.getPath().toString()) for x in fs.listStatus(make(path).getParent()) if x.getPath().getName().startswith((f".{name}.old-", f"{name}.old-")))
    if aside and not _renamed(fs, make(aside[-1][1]), make(path)):
        raise OSError(f"could not put {aside[-1][1]} back")


def _swap(spark: SparkSession, staged: dict[str, str]) -> None:
    """Moves written folders (target: staged) to their places, all or none; old ones go only once all new ones are there.

    A crash in between leaves old folders aside, where recover() finds them.
    """
    done: list[tuple] = []
    try:
        for path, stage in staged.items():
            fs, make = _fs(spark, path)
            recover(spark, path)
            old = make(make(path).getParent(), f".{make(path).getName()}.old-{uuid.uuid4().hex}")  # hidden from readers
            had = fs.exists(make(path))
            if had and not _renamed(fs, make(path), old):
                raise OSError(f"could not set {path} aside")
            done.append((fs, make(path), old if had else None, False))
            if not _renamed(fs, make(stage), make(path)):
                raise OSError(f"could not move {stage} to {path}")
            done[-1] = (*done[-1][:3], True)
    except Exception:
        for fs, target, old, moved in reversed(done):
            if moved:
                fs.delete(target, True)
            if old is not None:
                fs.rename(old, target)
        raise
    finally:
        for path, stage in staged.items():
            fs, make = _fs(spark, path)
            fs.delete(make(stage), True)
    for fs, _, old, _ in done:
        if old is not None:
            fs.delete(old, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder, one that a broken swap had set aside included."""
    recover(spark, path)
    fs, make = _fs(spark, path)
    return fs.exists(make(path))


def write_validated(outputs: dict[str, tuple[DataFrame, dict[str, Column]]]) -> None:
    """Writes every table (path: rows and rules) if no row of any breaks a rule; else nothing is written and the breaches are raised.

    Rows are written aside once, and what was written is judged and moved into place; on any failure nothing stays.
    """
    staged, spark = {}, None
    try:
        for path, (rows, _) in outputs.items():
            spark = rows.sparkSession
            staged[path] = f"{path}.new-{uuid.uuid4().hex}"
            rows.write.parquet(staged[path])
        for path, (rows, rules) in outputs.items():
            written = spark.read.schema(rows.schema).parquet(staged[path])
            broken = [r for r in violations(written, rules).collect() if r["n"]]  # a row for each rule
            if broken:
                raise ValueError(f"{path}: " + ", ".join(f"{r['rule']} {r['n']}" for r in broken))
        _swap(spark, staged)
    finally:
        for stage in staged.values():
            fs, make = _fs(spark, stage)
            fs.delete(make(stage), True)


def _staged(rows: DataFrame, path: str, ignore: tuple[str, ...] = ()) -> tuple[str, str]:
    """Writes rows beside path; where they are, and their fingerprint: the columns, the count, and the sum and bitwise sum of the rows' hashes.

    Counted while rows are written. A stage that ran twice may count twice; then the fingerprint fits no other.
    """
    columns = sorted(c for c in rows.columns if c not in ignore)
    hashed, seen = F.xxhash64(*(F.col(f"`{c}`") for c in columns)), Observation()
    told = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(hashed.cast("decimal(20,0)")).alias("sum"), F.bit_xor(hashed).alias("xor"))
    stage = f"{path}.new-{uuid.uuid4().hex}"
    told.write.parquet(stage)
    found = seen.get
    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in columns]
    short = lambda x: hashlib.sha256(repr(x).encode()).hexdigest()[:32]
    return stage, f"_fingerprint-{short(kinds)}-{short((found['n'], str(found['sum']), found['xor']))}"


def write_if_changed(rows: DataFrame, path: str, ignore: tuple[str, ...] = ()) -> bool:
    """Writes rows and says so, unless path holds the same rows already, columns in ignore aside.

    Rows are written aside with their fingerprint, an empty file whose name readers pass over. If the table at path
    has another one of the same columns it is replaced without being read; otherwise the rows themselves are compared.
    """
    spark = rows.sparkSession
    stage, mark = _staged(rows, path, ignore)
    fs, make = _fs(spark, stage)
    try:
        if exists(spark, path):
            alike = mark.rpartition("-")[0]  # of the same columns
            marks = [x.getPath().getName() for x in fs.listStatus(make(path)) if x.getPath().getName().startswith(alike)]
            if not marks or mark in marks:
                old, new = spark.read.parquet(path), spark.read.schema(rows.schema).parquet(stage)
                if set(old.columns) == set(rows.columns) and content_equal(new, old.select(*rows.columns), ignore).first()["equal"]:
                    return False
        fs.create(make(f"{stage}/{mark}")).close()
        _swap(spark, {path: stage})
        return True
    finally:
        fs.delete(make(stage), True)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def read_buckets(spark: SparkSession, path: str, schema, only: list[int] | None = None) -> DataFrame:
    """The rows of a table that write_buckets() keeps, with their bucket; of some buckets alone if only is given."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    whole = StructType([*(f for f in schema if f.name != "bucket"), StructField("bucket", IntegerType())])
    if not exists(spark, path):
        return spark.createDataFrame([], whole)
    fs, make = _fs(spark, path)
    for x in fs.listStatus(make(path)):  # one that a broken swap had set aside
        if (name := x.getPath().getName()).startswith(".bucket="):
            recover(spark, f"{path}/{name[1:].split('.old-')[0]}")
    rows = spark.read.schema(whole).parquet(path)
    return rows if only is None else rows.where(F.col("bucket").isin(*only))


def write_buckets(spark: SparkSession, tables: dict[str, DataFrame], changed: list[int], ledger: str | None = None) -> None:
    """Replaces the changed buckets of every table (path: rows with a bucket), all or none; the others' files stay.

    Tables hold a folder a bucket. ledger names an empty file that is left in the first table once all is in place.
    """
    staged, swaps = [], {}
    try:
        for path, rows in tables.items():
            stage = f"{path}.new-{uuid.uuid4().hex}"
            staged.append(stage)
            rows.where(F.col("bucket").isin(*changed)).repartition("bucket").write.partitionBy("bucket").parquet(stage)
            fs, make = _fs(spark, stage)
            fs.mkdirs(make(path))
            swaps |= {f"{path}/{x.getPath().getName()}": x.getPath().toString() for x in fs.listStatus(make(stage)) if x.getPath().getName().startswith("bucket=")}
        _swap(spark, swaps)
    finally:
        for stage in staged:
            fs, make = _fs(spark, stage)
            fs.delete(make(stage), True)
    if ledger:
        mark(spark, next(iter(tables)), ledger)


def mark(spark: SparkSession, path: str, name: str) -> None:
    """Leaves an empty file that readers pass over in a folder."""
    fs, make = _fs(spark, path)
    fs.mkdirs(make(path))
    fs.create(make(f"{path}/_{name}")).close()


def marked(spark: SparkSession, path: str, name: str) -> bool:
    fs, make = _fs(spark, path)
    return fs.exists(make(f"{path}/_{name}"))


def keep_stamp(new: DataFrame, old: DataFrame, key: str, stamp: str) -> DataFrame:
    """new, with the old stamp on every row whose other columns are as before."""
    rest = [c for c in new.columns if c not in (key, stamp)]
    was = old.select(key, F.struct(*rest).alias("_was"), F.col(stamp).alias("_stamp"))
    same = F.col("_was").eqNullSafe(F.struct(*rest)) & F.col("_stamp").isNotNull()
    return new.join(was, key, "left").withColumn(stamp, F.when(same, F.col("_stamp")).otherwise(F.col(stamp))).select(*new.columns)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Row number, reason, name and address as CSV, in order of the row number."""
    rejects.select("row", "reason", "name", "address").orderBy("row").write.mode("overwrite").option("header", True).csv(path)

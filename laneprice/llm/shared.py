"""Where jobs put tables that outlive a lost executor, and small helpers all operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting for the bytes of an Arrow batch, its default, and what operators on texts take instead.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"

#: Repetitions of a row that are listed at a time.
LISTED = 1 << 16


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends batches of BATCH_BYTES to Python workers unless it names another size itself.

    Every operator that sends rows to Python calls this, so none depends on which one ran before. Several
    tasks share an executor's memory, and each holds a few copies of its batch.
    """
    if df.sparkSession.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    return df


def quoted(column: str) -> Column:
    """The column of this very name, also if it has dots."""
    return F.col(f"`{column.replace('`', '``')}`")


def unused(columns: list[str], *stems: str) -> list[str]:
    """Names like the stems that no column has, upper and lower case alike."""
    taken, out = {c.lower() for c in columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def repeated(df: DataFrame, times: str, number: str) -> DataFrame:
    """Every row as often as its column times says, numbered from 1; listed in blocks, so no array grows with times."""
    (block,) = unused([*df.columns, number], "block")
    blocks = df.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) div {LISTED}"))))
    numbers = F.sequence(F.col(block) * LISTED + 1, F.least(F.col(times), (F.col(block) + 1) * LISTED))
    return blocks.select(*(F.col(f"`{c}`") for c in df.columns if c != times), F.explode(numbers).alias(number))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one is set only where none is named and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written to the shared folder: its lineage ends here and its readers share it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Deletes the folders of a table that written() gave, when everything that reads it has been written."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """As written(), for narrow tables; unlike a checkpoint it is computed once and has its real size in later plans."""
    return written(df, "cut")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

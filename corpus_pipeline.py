"""The corpus pipeline: quality rules, near-dedup, secrets, source mixing and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared
folder and reads it again as the next stage's docs. Every stage takes empty tables, nulls in any column,
rows that repeat and further columns of any name and type, and all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneprice.llm.mixing import mix_sources
from laneprice.llm.near_dedup import near_duplicates
from laneprice.llm.packing import pack_documents
from laneprice.llm.quality_rules import fit_quality, score_quality
from laneprice.llm.registry import tokenizer
from laneprice.llm.secrets import redact_secrets
from laneprice.llm.shared import quoted, table, written


def _whole(docs: DataFrame) -> DataFrame:
    """docs as one column, row: what else is in it can have any name and type."""
    return docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows that repeat are judged alike. Null and empty texts go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(_whole(docs), model, text_col="row.text").where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate group: the one with the smallest doc_id (nulls last), whatever rows share that id.

    Texts without words are in no group; of those one row stays for each doc_id and text, a null being a
    value of its own. Of rows with one doc_id and text the one with the smallest SHA-256 of its JSON stays.
    """
    found = near_duplicates(docs, shingle=5, percent=80, groups=True)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    kept = found.where("group IS NOT NULL").groupBy("group").agg(least.alias("r")).select("r.doc_id", "r.text_hash")
    kept = kept.union(found.where("group IS NULL").select("doc_id", "text_hash").distinct())
    keyed = lambda id_, h: F.xxhash64(id_.isNull(), id_, h).alias("key")
    kept = kept.select(keyed(F.col("doc_id"), F.col("text_hash")), "text_hash")
    # Rows with one doc_id and text are folded before they are shuffled.
    text_hash = F.xxhash64("row.text")
    rows = _whole(docs).select("row", keyed(F.col("row.doc_id"), text_hash), text_hash.alias("text_hash"))
    rows = rows.groupBy("key", "text_hash").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return rows.join(kept, ["key", "text_hash"], "left_semi").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their secrets masked and n_chars made anew (null for null texts). A null source is one owner."""
    rest = F.struct(*(quoted(c) for c in docs.columns if c != "text")).alias("row")
    clean = redact_secrets(docs.select(rest, "doc_id", "text", "source", "lang"), repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows replicated or left out so that every source, null among them, has an equal share of the text."""
    return mix_sources(_whole(docs), id_col="row.doc_id", source_col="row.source", text_col="row.text").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, packed into sequences of at most 2048 tokens; a null or empty text is one separator."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Quality and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""Queries of the operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_windows, read_back
from .lexical import ranked_search
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .neighbour_graph import nearest_by_graph
from .packing import pack_documents
from .prefix_trie import numbered_turns, prefix_trie, shared_heads
from .quality_rules import fit_quality, score_quality
from .secrets import BASE, find_secrets, listed
from .shared import table
from .sql import ORACLES
from .substring_dedup import substring_dedup
from .token_counts import count_tokens
from .top_k import exact_top_k
from .warc import read_archives, write_archives


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), min_words=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(spark, write_archives(table(spark, sf_dir, "pages"), least_revisit_bytes=0))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    count = lambda kind, name: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(name)
    kinds = [count(i, n) for i, n in enumerate(("n_assign", "n_access", "n_hex"))]
    live = F.size(F.filter("secrets", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *kinds, F.sha2(listed(F.filter("secrets", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), live)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 4).alias("quality"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ours = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], turns.schema)
    return read_back(format_windows(turns.union(ours), tokenizer_path=tokenizer("word_bpe_49k.json")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_nearest_by_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_graph(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = shared_heads(numbered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, convs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""Ranked lexical search of every document for a set of items, with equal bags of item terms scored once.

1. Documents are restricted to the items' vocabulary: each becomes its term counts and its number of terms.
2. Documents with the same counts and the same length factor m have the same score for every item. They
   are classes: dealt by a hash of both and told apart by the counts themselves, so a collision joins nothing.
3. The first member of each class is scored against blocks of items, classes streaming past the items.
4. The best classes of an item are expanded to their members by ascending doc_id. A class needs no more than
   its k first members for that, and an item no more than its k best classes, ordered by score and first member.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes as TERM sees them: a term's byte stays (in lower case), any other becomes a space.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())

#: A vocabulary of at most so many bytes goes to every executor; a larger one meets the documents' terms in a shuffle.
BROADCAST_VOCABULARY = 32 << 20
#: Term entries of a block of items, about; classes of a part; scores held at a time.
ITEM_ENTRIES, CLASS_PART, SCORES = 200_000, 8192, 1 << 21

_VECTORS = "row long, doc_id long, n long, terms array<long>, counts array<long>"
_BEST = "item long, class long, first_id long, score long"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), 0)


def _restricted(vocabulary):
    """Counts of the vocabulary's terms in every text, by ascending term; texts without any term at all are left out."""

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            rows, n, terms, counts = [], [], [], []
            for i, text in enumerate(batch["text"].cast(pa.binary())):
                words = (text.as_py() or b"").translate(_BYTES).split()
                if words:
                    held = sorted(Counter(x for x in map(number, words) if x is not None).items())
                    rows.append(i)
                    n.append(len(words))
                    terms.append([t for t, _ in held])
                    counts.append([c for _, c in held])
            few = batch.select(["row", "doc_id"]).take(pa.array(rows, pa.int64()))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*few.columns, pa.array(n, pa.int64()), pa.array(terms, lists), pa.array(counts, lists)], names=["row", "doc_id", "n", "terms", "counts"])

    return restrict


def _vectors(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, doc_id, n, terms and counts of every document with a term; vocabulary: term string, number long, unique."""
    size = vocabulary.agg(F.sum(F.octet_length("term") + 150)).first()[0] or 0
    if size <= BROADCAST_VOCABULARY:
        known = docs.sparkSession.sparkContext.broadcast({r["term"].encode(): r["number"] for r in vocabulary.collect()})
        return bounded_batches(docs).mapInArrow(_restricted(known), _VECTORS)
    # Counted before the join, so a frequent term comes once a document; its partition of the join can be split.
    counted = docs.select("row", F.explode(_terms(F.col("text"))).alias("term")).groupBy("row", "term").agg(F.count("*").alias("count"))
    held = counted.join(vocabulary, "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("number", "count"))).alias("held"))
    none = F.array().cast("array<long>")
    all_docs = docs.select("row", "doc_id", F.size(_terms(F.col("text"))).cast("long").alias("n")).where("n > 0")
    return all_docs.join(held, "row", "left").select("row", "doc_id", "n", F.coalesce("held.number", none).alias("terms"), F.coalesce("held.count", none).alias("counts"))


class _Items:
    """The items of a block by term, and the best classes of each so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.terms = k, [], None

    def add(self, batch: pa.RecordBatch) -> None:
        sizes = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
        self.parts.append((batch["id"].to_numpy(), sizes, batch["terms"].flatten().to_numpy(), batch["counts"].flatten().to_numpy()))

    def ready(self) -> None:
        ids, sizes, terms, weights = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(terms, kind="stable")
        self.ids, self.items, self.weights = ids, np.repeat(np.arange(len(ids)), sizes)[order], weights[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        # item, class, its first member's null flag and id, score; by item and rank
        self.best = [np.zeros(0, np.int64) for _ in range(5)]
        self.least = np.ones(len(ids), np.int64)

    def score(self, batch: pa.RecordBatch) -> None:
        sizes = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
        rows, terms, tf = np.repeat(np.arange(len(sizes)), sizes), batch["terms"].flatten().to_numpy(), batch["counts"].flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = self.terms[at] == terms
        rows, at, tf = rows[held], at[held], tf[held]
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * batch["m"].to_numpy()[rows])
        order = np.argsort(at, kind="stable")
        rows, at, impact = rows[order], at[order], impact[order]
        scores = np.zeros((len(sizes), len(self.ids)), np.int64)
        edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1)) if len(at) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            of = slice(self.starts[at[a]], self.ends[at[a]])
            scores[np.ix_(rows[a:b], self.items[of])] += np.outer(impact[a:b], self.weights[of])
        least = self.least
        if len(sizes) > self.k:
            least = np.maximum(least, np.partition(scores, len(sizes) - self.k, axis=0)[len(sizes) - self.k])
        row, item = np.nonzero(scores >= least)
        firsts = batch["doc_id"]
        found = item, batch["id"].to_numpy()[row], firsts.is_null().to_numpy(zero_copy_only=False)[row], firsts.fill_null(0).to_numpy()[row], scores[row, item]
        self.keep([np.concatenate(x) for x in zip(self.best, found, strict=True)])

    def keep(self, rows: list[np.ndarray]) -> None:
        item, _, none, first, score = rows
        order = np.lexsort((first, none, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
        self.best = [x[order][rank < self.k] for x in rows]
        last = rank == self.k - 1
        self.least[item[last]] = score[order][last]

    def found(self) -> pa.RecordBatch:
        item, number, none, first, score = self.best
        columns = [pa.array(self.ids[item]), pa.array(number), pa.array(first, mask=none.astype(bool)), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=["item", "class", "first_id", "score"])


def _scored(k: int):
    """Items come before classes in every (block, part) and are held while the classes stream past."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items = None, None
        for batch in batches:
            keys = [batch[c].cast(pa.int64()).to_numpy() for c in ("block", "part", "streams")]
            edges = np.flatnonzero(np.any([np.diff(x) != 0 for x in keys], axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                block, part, streams = (int(x[a]) for x in keys)
                if (block, part) != now:
                    if items is not None and items.terms is not None:
                        yield items.found()
                    now, items = (block, part), _Items(k)
                if not streams:
                    items.add(batch.slice(a, b - a))
                    continue
                if not items.parts:  # no item of the block has a term that any document holds
                    continue
                if items.terms is None:
                    items.ready()
                step = max(1, SCORES // len(items.ids))
                for i in range(a, b, step):
                    items.score(batch.slice(i, min(step, b - i)))
        if items is not None and items.terms is not None:
            yield items.found()

    return scored


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of every item, equal scores by ascending doc_id.

    Terms are the maximal matches of TERM in the whole text, A-Z lower-cased; a null or empty text has none.
    Scores are as the saturated tf-idf of the contract, in whole numbers; documents that score 0 are left out.
    Every row of docs is a document and every row of items an item of its own, also where rows or ids repeat
    or are null: a repeated document takes as many ranks, a null doc_id comes last among equal scores. Items
    without a term that some document holds, and empty tables, give no rows. Other columns are ignored.
    """
    own = F.monotonically_increasing_id()
    asked = items.select(own.alias("item"), F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    asked = written(asked.select("item", "item_id", F.explode(_terms(F.col("text"))).alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("q")), "items")
    vocabulary = written(asked.select("term").distinct().select("term", own.alias("number")), "vocabulary")

    docs = docs.select(own.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    vectors = written(_vectors(docs, vocabulary), "vectors")
    n, length = vectors.agg(F.count("*"), F.sum("n")).first()
    length = max(1, length or 0)

    # Classes: the hash decides where rows meet, the vector itself whether they are equal.
    m = F.expr(f"25 + (75 * n * {n}L) div {length}L")
    bags = vectors.where(F.size("terms") > 0).withColumn("m", m).withColumn("hash", F.xxhash64("terms", "counts", "m"))
    w = Window.partitionBy("hash", "terms", "counts", "m").orderBy(F.asc_nulls_last("doc_id"))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bags.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("class", F.first("row").over(so_far))
    only_first = lambda c: F.when(F.col("place") == 1, F.col(c)).alias(c)
    placed = written(placed.select("class", "place", "doc_id", "m", only_first("terms"), only_first("counts")), "classes")

    df = vectors.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1)))
    weights = df.join(vocabulary, "number").select("term", "number", weight.cast("long").alias("w")).where("w > 0")
    weighed = written(asked.join(weights, "term").select("item", "number", (F.col("q") * F.col("w")).alias("w")), "weights")

    entries, classes = weighed.count(), placed.where("place = 1").count()
    blocks, parts = max(1, math.ceil(entries / ITEM_ENTRIES)), max(16, math.ceil(classes / CLASS_PART))
    each = lambda times: F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    none = F.lit(None).cast("long")
    held = weighed.groupBy("item").agg(F.collect_list("number").alias("terms"), F.collect_list("w").alias("counts"))
    held = held.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), each(parts).alias("part"), F.lit(False).alias("streams"), F.col("item").alias("id"), none.alias("doc_id"), "terms", "counts", none.alias("m"))
    streams = placed.where("place = 1").select(each(blocks).alias("block"), F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("streams"), F.col("class").alias("id"), "doc_id", "terms", "counts", "m")
    met = bounded_batches(held.union(streams)).repartition("block", "part").sortWithinPartitions("block", "part", "streams")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first_id"), "class")
    best = met.mapInArrow(_scored(k), _BEST).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")

    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = best.join(placed.select("class", "doc_id"), "class").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")

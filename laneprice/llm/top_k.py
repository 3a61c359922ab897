"""Exact top-k search by inner product with the no-random-access algorithm, block by block.

Candidates are dealt once into blocks of bounded size, close ones together: the nearest of a few centres,
fitted on a bounded sample, and a hash. In a block every component is a sorted list, read from its high
end for positive and its low end for negative query components.

1. Every query reads the lists of its own block; its k-th best lower bound there is its threshold.
2. A block's list ends bound the score of all its candidates. A query is sent on only to blocks that its
   threshold doesn't rule out; candidates never move again.
3. There it reads the lists, depth by depth, until candidates that no list has shown yet can't qualify,
   keeps those whose upper bound (unread components at the frontiers) reaches the threshold, and resolves
   their final scores.

A block's candidates are held by one task while its queries stream past, so neither side meets as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .shared import bounded_batches, written

#: Candidates of a block, about; queries that read its lists at a time.
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 256
#: Rows that the centres are fitted on, centres, and rounds of fitting, at most.
SAMPLE_ROWS, CENTRES, ROUNDS = 4096, 256, 5
#: List ends of blocks (1 KB each for 64 components) that a task holds, and queries that stream past them, about.
SLICE_BLOCKS, SLICE_QUERIES = 5000, 100_000
#: Parts in which the lists are read.
STEPS = 16
#: Products beyond this aren't exact in doubles.
EXACT = float(1 << 52)
_BIG = 2**63 - 1


def _matrix(lists: pa.Array, scale: float | None) -> np.ndarray:
    """Rows of floor(scale * x), shorter ones filled up with zeros; scale None: of x."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values if scale is None else np.floor(scale * values)
    return out


def _widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (a, b))


class Lists:
    """The candidates of a block and their components as sorted lists."""

    def __init__(self, ids: np.ndarray, items: np.ndarray):
        self.ids, self.items, self.ranked = ids, items, np.sort(items, axis=0)

    def frontiers(self, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """What each list shows last from its high and from its low end, and the entries read of it."""
        read = min(len(self.ids), math.ceil(len(self.ids) * depth / STEPS))
        return self.ranked[len(self.ids) - read], self.ranked[read - 1], read

    def search(self, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """A query's place, ids and scores of its k best candidates of at least least, ties to the smaller id, and the entries read.

        Its own id is left out. Scores must be exact in doubles.
        """
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        if not np.isfinite(least).all():
            least = np.where(np.isfinite(least), least, self._threshold(up, down, query_ids, k))
        # The depth from which on a candidate that no list has shown can't qualify; all is read at the last one.
        depth = np.full(len(queries), STEPS)
        for d in range(STEPS - 1, 0, -1):
            high, low, _ = self.frontiers(d)
            depth[up @ high + down @ low < least] = d
        for d in np.unique(depth):
            high, low, read = self.frontiers(int(d))
            active = np.flatnonzero(depth == d)
            upper = up[active] @ np.maximum(self.items, high if read < len(self.ids) else self.ranked[0]).T
            upper += down[active] @ np.minimum(self.items, low if read < len(self.ids) else self.ranked[-1]).T
            left = (upper >= least[active, None]) & (self.ids[None, :] != query_ids[active, None])
            for at, row in zip(active.tolist(), left, strict=True):
                who = np.flatnonzero(row)
                score = self.items[who] @ queries[at]
                order = np.lexsort((self.ids[who], -score))[:k]
                yield at, self.ids[who[order]], score[order], read * queries.shape[1]

    def _threshold(self, up: np.ndarray, down: np.ndarray, query_ids: np.ndarray, k: int) -> np.ndarray:
        """The k-th best lower bound when half of the lists is read: unread components are at the lists' worst ends."""
        high, low, _ = self.frontiers(STEPS // 2)
        lower = up @ np.where(self.items >= high, self.items, self.ranked[0]).T + down @ np.where(self.items <= low, self.items, self.ranked[-1]).T
        lower[self.ids[None, :] == query_ids[:, None]] = -np.inf
        return np.full(len(up), -np.inf) if lower.shape[1] <= k else np.partition(lower, lower.shape[1] - k, axis=1)[:, -k]


def _exactly(queries: np.ndarray, query_ids: np.ndarray, items: np.ndarray, ids: np.ndarray, k: int):
    """The same with Python's integers, for components too large for exact doubles; all entries are read."""
    rows = [[int(x) for x in r] for r in items]
    for at, q in enumerate(queries):
        q = [int(x) for x in q]
        scored = sorted((-sum(a * b for a, b in zip(q, r, strict=True)), i) for i, r in zip(ids.tolist(), rows, strict=True) if i != query_ids[at])[:k]
        yield at, np.array([i for _, i in scored], dtype=np.int64), np.array([max(-_BIG - 1, min(_BIG, -s)) for s, _ in scored], dtype=object), items.size


_FOUND = "block long, row long, query_id long, vec_id long, score long, entries long, low array<double>, high array<double>"
_KINDS = [pa.int64()] * 6 + [pa.list_(pa.float64())] * 2
_ROW = "block long, asks boolean, row long, id long, v array<double>, least long"


def _batch(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


class _Block:
    """Candidates of a block, gathered from batches; their lists are made for the first query."""

    def __init__(self, number: int):
        self.number, self.ids, self.rows, self.lists = number, [], [], None

    def add(self, batch: pa.RecordBatch, scale: float) -> None:
        self.ids.append(batch["id"].to_numpy())
        self.rows.append(_matrix(batch["v"], scale))

    def matrix(self) -> np.ndarray:
        while len(self.rows) > 1:
            self.rows = [np.concatenate(_widened(*self.rows[i : i + 2])) if i + 1 < len(self.rows) else self.rows[i] for i in range(0, len(self.rows), 2)]
        return self.rows[0]

    def ends(self) -> tuple:
        """The ends of all lists; every component of a row that has fewer is zero."""
        rows = self.matrix()
        return self.number, None, None, None, None, None, rows.min(axis=0).tolist(), rows.max(axis=0).tolist()

    def search(self, batch: pa.RecordBatch, k: int, scale: float) -> Iterator[tuple]:
        ids = np.concatenate(self.ids)
        queries, items = _widened(_matrix(batch["v"], scale), self.matrix())
        if self.lists is None or self.lists.items.shape[1] < items.shape[1]:
            self.lists = Lists(ids, items)
        own, row = batch["id"].to_numpy(), batch["row"].to_numpy().tolist()
        least = batch["least"].cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        exact = np.abs(queries).max(initial=0) * np.abs(items).max(initial=0) * max(1, items.shape[1]) < EXACT
        for at, who, score, entries in self.lists.search(queries, own, least, k) if exact else _exactly(queries, own, items, ids, k):
            yield self.number, row[at], int(own[at]), None, None, entries, None, None
            for i, x in zip(who.tolist(), score.tolist(), strict=True):
                yield self.number, row[at], int(own[at]), i, int(x), 0, None, None


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of batches whose rows agree in the keys (integers or flags)."""
    for batch in batches:
        columns = [batch[c].cast(pa.int64()).to_numpy() for c in keys]
        edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1 if batch.num_rows else []
        for a, b in zip([0, *edge], [*edge, batch.num_rows], strict=True):
            if b > a:
                yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _meet(k: int, scale: float):
    """Candidates come before queries in every block and are held while its queries stream past. Gives what is found, and the list ends."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for (number, asks), part in _runs(batches, "block", "asks"):
            if block is None or block.number != number:
                if block is not None:
                    yield _batch([block.ends()], _KINDS, _FOUND)
                block = _Block(number)
            if not asks:
                block.add(part, scale)
            else:
                for i in range(0, part.num_rows, QUERY_BLOCK):
                    yield _batch(list(block.search(part.slice(i, QUERY_BLOCK), k, scale)), _KINDS, _FOUND)
        if block is not None:
            yield _batch([block.ends()], _KINDS, _FOUND)

    return meet


def _reach(scale: float):
    """List ends come before queries in every slice; a query goes on to the blocks that its least score doesn't rule out."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends = None, []
        for (number, asks), part in _runs(batches, "slice", "asks"):
            if number != now:
                now, ends = number, []
            if not asks:
                ends.append((part["block"].to_numpy(), _matrix(part["low"], None), _matrix(part["high"], None)))
                continue
            if len(ends) > 1:
                low, high = ends[0][1], ends[0][2]
                for _, x, y in ends[1:]:
                    low, high = np.concatenate(_widened(low, x)), np.concatenate(_widened(high, y))
                ends = [(np.concatenate([x[0] for x in ends]), low, high)]
            blocks, low, high = ends[0]
            for i in range(0, part.num_rows, QUERY_BLOCK):
                few = part.slice(i, QUERY_BLOCK)
                least = few["least"].cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                at, where = np.nonzero(_reached(low, high, _matrix(few["v"], scale), least) & (blocks[None, :] != few["block"].to_numpy()[:, None]))
                asked = few.select(["row", "id", "v", "least"]).take(pa.array(at))
                flags = pa.array(np.ones(len(at), dtype=bool))
                yield pa.RecordBatch.from_arrays([pa.array(blocks[where]), flags, *asked.columns], names=[x.split()[0] for x in _ROW.split(", ")])

    return reach


def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a sample by a few rounds of k-means."""
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)] if len(sample) else np.zeros((1, 0))
    for _ in range(ROUNDS if sample.size else 0):
        nearest = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        sizes = np.bincount(nearest, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):  # any block will do for a row that overflows
        return np.argmax(rows[:, : centres.shape[1]] @ centres[:, : rows.shape[1]].T - (centres**2).sum(axis=1) / 2, axis=1)


def _dealt(centres):
    def deal(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(_nearest(_matrix(column, None), centres.value), pa.int32())

    return arrow_udf(deal, "int").asNondeterministic()


def _reached(low: np.ndarray, high: np.ndarray, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which blocks, by their list ends, may hold a candidate of a query's least score."""
    queries, high = _widened(queries, high)
    low = np.pad(low, ((0, 0), (0, high.shape[1] - low.shape[1])))
    with np.errstate(over="ignore", invalid="ignore"):
        upper = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        size = np.abs(queries).max(axis=1, initial=0)[:, None] * np.maximum(np.abs(low), np.abs(high)).max(axis=1, initial=0)[None, :]
        return ~(upper < least[:, None]) | ~(size * max(1, queries.shape[1]) < EXACT)


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, counted: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for every row that is_query holds for.

    A component x counts as floor(scale * x); the score is the integer inner product, held to the range of
    a long. Ties go to the smaller id; a query doesn't find rows of its own id. Rows with a null id or vector, or with
    a null or non-finite component, take no part. Rows equal in id and vector count once; other rows that
    repeat an id are each found, and as queries share the k ranks of their id. A shorter vector is filled up
    with zeros, an empty one scores 0. Fewer than k other rows: all of them. counted: with entries_read, the
    list entries that a query id read in all blocks; without the search, it would be rows times components.
    """
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = valid.where("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity'))")
    n, asking = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    rows = valid.orderBy(F.xxhash64("id", "v")).limit(SAMPLE_ROWS).select("v").collect()
    sample = _matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), None)
    centres = vectors.sparkSession.sparkContext.broadcast(_centres(sample, max(1, min(CENTRES, len(sample), math.ceil(n / CANDIDATE_BLOCK)))))

    folded = valid.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    dealt = bounded_batches(folded).select("id", "v", "asks", F.monotonically_increasing_id().alias("row"), _dealt(centres)(F.col("v")).alias("centre"))
    dealt = written(dealt, "vectors")
    sizes = dict(dealt.groupBy("centre").count().collect())  # a row for each centre
    if not sizes:
        empty = "query_id long, rank int, vec_id long, score long" + (", entries_read long" if counted else "")
        return vectors.sparkSession.createDataFrame([], empty)
    parts = F.array(*(F.lit(math.ceil(sizes.get(c, 1) / CANDIDATE_BLOCK)) for c in range(max(sizes) + 1)))
    block = F.col("centre").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("id", "v"), F.element_at(parts, F.col("centre") + 1))
    dealt = dealt.withColumn("block", block)
    none = F.lit(None).cast("long")

    def searched(asked: DataFrame) -> DataFrame:
        items = dealt.select("block", F.lit(False).alias("asks"), "row", "id", "v", none.alias("least"))
        rows = items.union(asked.select(*items.columns)).repartition("block").sortWithinPartitions("block", "asks")
        return rows.mapInArrow(_meet(k, scale), _FOUND)

    asked = dealt.where("asks")
    first = written(searched(asked.select("block", "asks", "row", "id", "v", none.alias("least"))), "found")
    least = first.where("vec_id IS NOT NULL").groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    ends = first.where("low IS NOT NULL").select("block", "low", "high")
    slices, streams = max(1, math.ceil(ends.count() / SLICE_BLOCKS)), max(1, math.ceil(asking / SLICE_QUERIES))
    each = lambda times: F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    slice_of = lambda a, b: (a.cast("long") * streams + b).alias("slice")
    lists = F.lit(None).cast("array<double>")
    ends = ends.select("*", F.pmod(F.xxhash64("block"), F.lit(slices)).alias("x"), each(streams).alias("y"))
    ends = ends.select(slice_of(F.col("x"), F.col("y")), F.lit(False).alias("asks"), none.alias("row"), none.alias("id"), lists.alias("v"), none.alias("least"), "block", "low", "high")
    going = asked.join(least, "row", "left").select("*", each(slices).alias("x"), F.pmod(F.xxhash64("row"), F.lit(streams)).alias("y"))
    going = going.select(slice_of(F.col("x"), F.col("y")), "asks", "row", "id", "v", "least", "block", lists.alias("low"), lists.alias("high"))
    reached = ends.union(going).repartition("slice").sortWithinPartitions("slice", "asks").mapInArrow(_reach(scale), _ROW)
    found = first.union(searched(reached)).where("query_id IS NOT NULL")
    ranked = found.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    ranked = ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if counted:
        ranked = ranked.join(found.groupBy("query_id").agg(F.sum("entries").alias("entries_read")), "query_id")
    return ranked

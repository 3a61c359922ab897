"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, greedy search reads it.

1. Rows with equal vectors are one node. Vectors are rotated and rounded to bytes for building and searching;
   what is found is scored again on the original vectors.
2. First neighbours: nodes are sorted by the signs of random projections, so that close ones often stand
   together, and the nodes of every stretch of CELL know each other. This is done PASSES times.
3. NN-descent: a node's list (NEIGHBOURS) and some that list it (REVERSE, new ones first) meet in its group,
   joined to their vectors; pairs with a new link offer each other where that betters their lists. New links
   of one round are the only ones that bring pairs in the next; rounds end when few links are new.
4. Greedy search: a query begins with the list of its own node and keeps the BEAM best nodes seen. Those not
   visited yet join the lists of the graph, whose nodes enter the beam if they are better than its last.

Groups, stretches, lists and beams are bounded by these parameters, copies of a vector however many are one
node, and nodes that very many list offer at most their best links from each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, deleted, written

#: Length of a node's list, and how many of those that list it join its group.
NEIGHBOURS, REVERSE = 40, 40
#: Stretches, the links that a node takes from one, and the number of sortings.
CELL, FIRST, PASSES = 1024, 16, 4
#: Links that a node is offered by one group, at most.
OFFERS = 8
#: Rounds at most, and the share of new links at which they end.
ROUNDS, SETTLED = 12, 0.02
#: Best nodes that a query keeps, hops at most, and how many of the best are scored exactly for each of the k.
BEAM, HOPS, RESCORED = 192, 16, 2
#: Signs that order the nodes.
SIGNS = 40
#: Vectors (and the queries' open nodes) of at most so many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

_EDGE = "a long, b long, score float, fresh boolean"


def _packed(dim: int):
    """Vectors as bytes of their rotation, filled up to dim, and the scale of a byte."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))[0]
        for batch in batches:
            sizes = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
            rows = np.zeros((len(sizes), dim))
            at = np.repeat(np.arange(len(sizes)), sizes)
            rows[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = batch["v"].flatten().to_numpy()
            most = np.abs(rows).max(axis=1, initial=0, keepdims=True)
            rows = (rows / most) @ turn  # any length of vector is safe from overflow
            peak = np.abs(rows).max(axis=1, initial=0, keepdims=True)
            bytes_ = np.rint(rows / peak * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch["node"], _binary(bytes_), pa.array((peak * most)[:, 0] / 127)], names=["node", "q", "scale"])

    return pack


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] if rows.ndim == 2 else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _floats(batch, q: str = "q", scale: str = "scale") -> np.ndarray:
    """The vectors of a batch; scores are taken in single precision of scaled bytes."""
    column = batch[q].combine_chunks() if isinstance(batch[q], pa.ChunkedArray) else batch[q]
    rows = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1).astype(np.float32)
    return rows * batch[scale].to_numpy().astype(np.float32)[:, None]


def _edges(a, b, score, fresh=True) -> pa.RecordBatch:
    columns = [pa.array(a), pa.array(b), pa.array(score, pa.float32()), pa.array(np.full(len(a), fresh))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "score", "fresh"])


def _signs(seed: int, dim: int):
    """Adds the signs of random projections as a number, the first sign weighing most."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(1000 + seed).standard_normal((dim, SIGNS)).astype(np.float32)
        for batch in batches:
            code = (_floats(batch) @ planes > 0) @ (1 << np.arange(SIGNS, dtype=np.int64)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    return signs


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each node to its FIRST best of its stretch; a short rest joins the stretch before."""
    ids, rows = np.zeros(0, np.int64), None

    def links(n: int) -> pa.RecordBatch:
        score = rows[:n] @ rows[:n].T
        np.fill_diagonal(score, -np.inf)
        few = min(FIRST, n - 1)
        best = np.argpartition(score, n - few, axis=1)[:, n - few :] if few > 0 else np.zeros((n, 0), int)
        return _edges(np.repeat(ids[:n], max(few, 0)), ids[best.ravel()], np.take_along_axis(score, best, axis=1).ravel())

    for batch in batches:
        ids = np.concatenate([ids, batch["node"].to_numpy()])
        rows = _floats(batch) if rows is None else np.concatenate([rows, _floats(batch)])
        while len(ids) >= 2 * CELL:
            yield links(CELL)
            ids, rows = ids[CELL:], rows[CELL:]
    if len(ids):
        yield links(len(ids))


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables that hold all rows of their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch[key].to_numpy()
        first = int(np.searchsorted(ids, ids[-1]))  # the last key may go on
        if held and ids[0] != held[-1][key][-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offers between the members of a group (m; x, q, scale, fresh, least) that its new links bring, the best of a batch."""
    for table in _whole(batches, "m"):
        m, x, fresh, least = (table[c].to_numpy() for c in ("m", "x", "fresh", "least"))
        rows = _floats(table)
        edges = np.flatnonzero(np.diff(m, prepend=m[0] - 1, append=m[-1] + 1))
        found = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            new = fresh[i:j]
            if j - i < 2 or not new.any():
                continue
            score = rows[i:j] @ rows[i:j].T
            score[~(new[:, None] | new[None, :]) | (score <= least[i:j, None])] = -np.inf
            np.fill_diagonal(score, -np.inf)
            if j - i > OFFERS:
                other = np.argpartition(score, j - i - OFFERS, axis=1)[:, j - i - OFFERS :]
                score, row = np.take_along_axis(score, other, axis=1).ravel(), np.repeat(np.arange(j - i), OFFERS)
                other = other.ravel()
            else:
                row, other = np.divmod(np.arange((j - i) ** 2), j - i)
                score = score.ravel()
            kept = score > -np.inf
            if kept.any():
                found.append((x[i:j][row[kept]], x[i:j][other[kept]], score[kept]))
        if found:
            yield _edges(*_best(*(np.concatenate(c) for c in zip(*found, strict=True))))


def _best(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every pair once, and of a node's pairs the NEIGHBOURS best."""
    order = np.lexsort((b, -score, a))
    a, b, score = a[order], b[order], score[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # copies of a pair have one score, so they stand together
    a, b, score = a[once], b[once], score[once]
    starts = np.flatnonzero(np.diff(a, prepend=a[0] - 1))
    kept = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) < NEIGHBOURS
    return a[kept], b[kept], score[kept]


def _sized(df: DataFrame, rows: int, width: int) -> DataFrame:
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def _lists(links: DataFrame) -> DataFrame:
    """The NEIGHBOURS best links of every node; a link known before isn't new."""
    once = links.groupBy("a", "b").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return once.withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS).drop("rank")


def _groups(lists: DataFrame, seed: int) -> DataFrame:
    """m, x and fresh: every node's list and at most REVERSE of those that list it."""
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("fresh"), F.xxhash64("a", "b", F.lit(seed))))
    back = lists.withColumn("rank", rank).where(F.col("rank") <= REVERSE)
    sides = lists.select(F.col("a").alias("m"), F.col("b").alias("x"), "fresh").union(back.select("b", "a", "fresh"))
    return sides.groupBy("m", "x").agg(F.max("fresh").alias("fresh"))


def neighbour_graph(packed: DataFrame, nodes: int, dim: int) -> DataFrame:
    """Links (a, b, score, fresh) of every node's NEIGHBOURS nearest found; packed: node, q, scale."""
    started = []
    for seed in range(PASSES):
        coded = packed.mapInArrow(_signs(seed, dim), "node long, q binary, scale double, code long")
        started.append(coded.repartitionByRange("code", "node").sortWithinPartitions("code", "node").mapInArrow(_stretches, _EDGE))
    links = started[0]
    for more in started[1:]:
        links = links.union(more)
    lists = written(_lists(links), "links")
    width = dim + 64
    for seed in range(ROUNDS):
        if not lists.where("fresh").count() > SETTLED * nodes * NEIGHBOURS:
            break
        least = lists.groupBy("a").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("score")).alias("least"))
        known = packed.join(least, packed["node"] == least["a"], "left").select(F.col("node").alias("x"), "q", "scale", F.coalesce("least", F.lit(float("-inf")).cast("float")).alias("least"))
        met = _groups(lists, seed).join(_sized(known, nodes, width), "x").select("m", "x", "fresh", "q", "scale", "least")
        offers = met.repartition("m").sortWithinPartitions("m").mapInArrow(_meetings, _EDGE)
        before, lists = lists, written(_lists(lists.withColumn("fresh", F.lit(False)).union(offers)), "links")
        deleted(before)
    return lists


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores the listed nodes (ids, qs, scales) of an open node for its query (q, scale, least); those that may enter its beam."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch["ids"].value_lengths().to_numpy(zero_copy_only=False)
        row, ids = np.repeat(np.arange(len(sizes)), sizes), batch["ids"].flatten().to_numpy()
        listed = np.frombuffer(b"".join(batch["qs"].to_pylist()), np.int8).reshape(len(ids), -1).astype(np.float32)
        score = np.einsum("ij,ij->i", listed, _floats(batch)[row]) * batch["scales"].flatten().to_numpy().astype(np.float32)
        query = batch["query"].to_numpy()[row]
        kept = (score > batch["least"].to_numpy()[row]) & (ids != query)
        if kept.any():
            a, b, s = _best_of(query[kept], ids[kept], score[kept])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s, pa.float32()), pa.array(np.zeros(len(a), bool))], names=["query", "node", "score", "done"])


def _best_of(a, b, score):
    """Every pair once."""
    order = np.lexsort((b, a))
    a, b, score = a[order], b[order], score[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[once], b[once], score[once]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node with the ids, bytes and scales of its group."""
    for table in _whole(batches, "m"):
        m = table["m"].to_numpy()
        edges = np.flatnonzero(np.diff(m, prepend=m[0] - 1, append=m[-1] + 1)).astype(np.int32)
        qs = table["q"].to_pylist()
        lists = [pa.ListArray.from_arrays(pa.array(edges), table[c].combine_chunks()) for c in ("x", "scale")]
        joined = pa.array([b"".join(qs[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(m[edges[:-1]]), lists[0], joined, lists[1]], names=["node", "ids", "qs", "scales"])


def greedy_search(lists: DataFrame, packed: DataFrame, queries: DataFrame, nodes: int, dim: int) -> DataFrame:
    """query, node and score of the BEAM best nodes found for every query node (queries: node), itself left out."""
    joined = _groups(lists, ROUNDS).join(_sized(packed.withColumnRenamed("node", "x"), nodes, dim + 64), "x")
    graph = written(joined.select("m", "x", "q", "scale").repartition("m").sortWithinPartitions("m").mapInArrow(_listed, "node long, ids array<long>, qs binary, scales array<double>"), "graph")
    queries = written(queries.join(packed, "node").select(F.col("node").alias("query"), "q", "scale"), "queries")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))

    def kept(beam: DataFrame) -> DataFrame:
        return written(beam.withColumn("rank", rank).where(F.col("rank") <= BEAM).drop("rank"), "beam")

    beam = kept(lists.join(queries.select(F.col("query").alias("a")), "a", "left_semi").select(F.col("a").alias("query"), F.col("b").alias("node"), "score", F.lit(False).alias("done")))
    for _ in range(HOPS):
        n = beam.where("NOT done").count()
        if not n:
            break
        least = beam.groupBy("query").agg(F.when(F.count("*") >= BEAM, F.min("score")).alias("least"))
        least = least.select("query", F.coalesce("least", F.lit(float("-inf")).cast("float")).alias("least"))
        going = beam.where("NOT done").select("query", "node").join(queries.join(least, "query"), "query")
        seen = bounded_batches(_sized(going, n, dim + 64).join(graph, "node")).select("query", "q", "scale", "least", "ids", "qs", "scales")
        seen = seen.mapInArrow(_visits, "query long, node long, score float, done boolean")
        both = beam.withColumn("done", F.lit(True)).union(seen).groupBy("query", "node").agg(F.max("score").alias("score"), F.max("done").alias("done"))
        before, beam = beam, kept(both)
        deleted(before)
    deleted(graph)
    return beam.select("query", "node", "score")


def nearest_by_graph(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for every row that is_query holds for.

    Nearness is the inner product in double precision, exact for all that is returned; which rows are found is
    approximate (recall is tested against brute force). Equal scores go by ascending vec_id; a query doesn't
    find rows of its own id. Rows with a null id or vector, a zero vector, or a null or non-finite component take
    no part; a shorter vector counts as filled up with zeros. Rows equal in id and vector count once. Fewer than
    k other rows: all that are found. An empty table gives no rows; other columns are ignored.
    """
    whole = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = whole.where("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    # Trailing zeros don't tell vectors apart.
    used = F.expr("size(v) - coalesce(array_position(reverse(transform(v, x -> x <> 0)), true), 0) + 1")
    valid = written(valid.withColumn("v", F.slice("v", 1, used.cast("int"))), "vectors")
    nodes = written(valid.groupBy("v").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("node"), "v"), "nodes")
    count, dim = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    key = F.xxhash64("v").alias("h")
    placed = written(valid.select("*", key).join(nodes.select("*", key), ["h", "v"]).groupBy("id", "node").agg(F.max("asks").alias("asks")), "placed")
    packed = written(bounded_batches(nodes).mapInArrow(_packed(dim), "node long, q binary, scale double"), "packed")

    lists = neighbour_graph(packed, count, dim)
    asking = placed.where("asks").select("node").distinct()
    beam = greedy_search(lists, packed, asking, count, dim)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    close = beam.withColumn("rank", rank).where(F.col("rank") <= RESCORED * k).select("query", "node")
    # A query's own node may have other rows.
    close = close.union(asking.select(F.col("node").alias("query"), "node"))
    of = nodes.select(F.col("node").alias("query"), F.col("v").alias("w"))
    product = F.aggregate(F.zip_with("v", "w", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    scored = close.join(of, "query").join(nodes, "node").select("query", "node", product.alias("score"))

    # k + 1 members of a node are enough for every query row: one of them may be the row itself.
    member = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    members = placed.select("node", "id").withColumn("member", member).where(F.col("member") <= k + 1).select("node", "id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = scored.join(members, "node").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    rows = placed.where("asks").select(F.col("node").alias("query"), F.col("id").alias("query_id"))
    found = rows.join(best.select("query", F.col("id").alias("vec_id"), "score"), "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""The trie of all conversation prefixes, built by van Emde Boas recursion.

A tree of height 2h is cut at half depth: every sequence's first h turns are named, equal names under one
root are one cut prefix, and what is left are trees of height h, all of the same shape: the upper one, with
each cut prefix once, and a lower one for the sequences that go on from each cut prefix. All trees of a
height are cut in the same Spark jobs, so a trie of depth d takes about log2(d) rounds, whatever its size.

* Names. Turn i of a sequence has a 128-bit digest; blocks of 2, 4, 8... turns that begin at multiples of
  their size have the digest of their halves'. A tree's root lies at a multiple of its height, so the
  first half of its sequences is such a block, and naming it is one join on (sequence, block).
* Nodes. A node is known by its smallest member and its depth. Trees of height 1 are the nodes and their parents.
* Totals. A tree of height h gives every full-length sequence's last node the root above it, h turns away:
  doubled, these links list the h nearest ancestors of a node whose depth is an odd multiple of h. From
  height 1 up, such nodes graft what is summed below them onto those ancestors: they are the cut nodes, and
  their lower trees are complete by then. A sequence of d turns takes part d/2 log2(d) times at most.

No step gathers a conversation, a node's members or its children: rows are turns, blocks and nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Characters of listed ids that are joined before they are digested in order.
LISTED_CHARS = 1 << 16
_NOTHING = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    """128 bits of the SHA-256 of the parts, each a string or binary."""
    return F.unhex(F.substring(F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256), 1, 32))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted rows of a sequence within the partition, and adds the partition's number."""
    last, count, part = None, 0, TaskContext.get().partitionId()
    for batch in batches:
        ids = batch["seq"].to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        at = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        if ids[0] == last:
            at[: starts[1] if len(starts) > 1 else len(at)] += count
        last, count = ids[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part)), pa.array(at)], names=[*batch.schema.names, "part", "at"])


def numbered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """seq, pos (from 0), key (digest of role and text) and bytes (of the text) of every turn.

    By turn, null first; equal turns by their key. Null roles and texts are empty; rows with a null id take no
    part. A sequence may span any number of partitions: only those that do are told where they begin.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    key = _digest(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(F.col(f"`{id_col}`").cast("long").alias("seq"), F.col(f"`{turn_col}`").cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["seq", F.asc_nulls_first("turn"), "key"]
    rows = rows.where("seq IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.mapInArrow(_counted, "seq long, turn long, key binary, bytes long, part long, at long"), "turns")
    before = F.sum("n").over(Window.partitionBy("seq").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = rows.groupBy("seq", "part").agg(F.count("*").alias("n")).withColumn("before", before).where("before > 0")
    # A partition continues one sequence at most, so spans has fewer rows than there are partitions.
    rows = rows.join(F.broadcast(spans.drop("n")), ["seq", "part"], "left")
    return rows.select("seq", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "bytes")


def shared_heads(turns: DataFrame, every: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Sequences that share heads: (seq, pos, key, bytes) of the turns, and (seq) of all sequences, also those without turns.

    turns as from numbered_turns. Sequence c begins with the first h turns of sequence c - c % every, if there
    is one, and goes on with its own after its first h; h is the CRC-32 of c in decimals modulo longest.
    """
    turns = written(turns, "numbered")
    h = (F.crc32(F.col("seq").cast("string").cast("binary")) % longest).alias("h")
    seqs = turns.select("seq").distinct().select("seq", (F.col("seq") - F.col("seq") % every).alias("base"), h)
    heads = turns.where(F.col("pos") < longest - 1).withColumnRenamed("seq", "base")
    lengths = heads.groupBy("base").agg(F.count("*").alias("n"))
    seqs = written(seqs.join(lengths, "base", "left").withColumn("n", F.least("h", F.coalesce("n", F.lit(0)))), "heads")
    first = seqs.join(heads, "base").where("pos < h").select("seq", "pos", "key", "bytes")
    own = turns.where(F.col("pos") >= h).join(seqs.select("seq", "h", "n"), "seq")
    return first.union(own.select("seq", (F.col("n") + F.col("pos") - F.col("h")).alias("pos"), "key", "bytes")), seqs.select("seq")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of consecutive ids of a name, joined by commas, of about LISTED_CHARS."""
    name, first, ids, size = None, 0, [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["name", "first", "ids"])

    for part in batches:
        for x, seq in zip(part["name"].to_pylist(), part["seq"].to_pylist(), strict=True):
            if ids and (x != name or size > LISTED_CHARS):
                yield batch()
                ids, size = [], 0
            if not ids:
                name, first = x, seq
            ids.append(str(seq))
            size += len(ids[-1]) + 1
    if ids:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest id of a name and the digest of its lists, which come in order; one list is held at a time."""
    name, first, running = None, 0, None
    for part in batches:
        out = []
        for x, seq, ids in zip(part["name"].to_pylist(), part["first"].to_pylist(), part["ids"].to_pylist(), strict=True):
            if x != name or running is None:
                if running is not None:
                    out.append((first, running.hexdigest()))
                name, first, running = x, seq, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string()))], names=["ends", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([running.hexdigest()])], names=["ends", "ends_sha256"])


def _ends(named: DataFrame) -> DataFrame:
    """ends (the smallest seq of a name), ends_sha256 (of all its seqs, ascending, comma-joined). A digest is made in order, so by one task, from lists that many have joined."""
    lists = named.repartitionByRange("name", "seq").sortWithinPartitions("name", "seq").mapInArrow(_joined, "name binary, first long, ids string")
    return lists.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "ends long, ends_sha256 string")


def _sum_of(frames: list[DataFrame]) -> DataFrame:
    """Totals by node over frames of (seq, depth, leaves, saved)."""
    return reduce(DataFrame.union, frames).groupBy("seq", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """A row per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: seq long, pos long (from 0, without gaps), key binary, bytes long; (seq, pos) is unique. seqs: every
    seq once; those without turns are members of the root alone. Without any seq there is no node.
    """
    blocks = [written(turns.select("seq", F.col("pos").alias("block"), F.col("key").alias("name"), "bytes"), "blocks")]
    least, longest = seqs.agg(F.min("seq")).first()[0], blocks[0].agg(F.max("block")).first()[0]
    height = 0 if longest is None else int(longest).bit_length()  # of 2^height turns, the longest sequence's at least
    for _ in range(height):
        half = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("name")))
        pairs = blocks[-1].groupBy("seq", F.expr("block div 2").alias("block")).agg(half(0).alias("l"), half(1).alias("r"))
        blocks.append(written(pairs.select("seq", "block", F.when(F.col("r").isNull(), F.col("l")).otherwise(_digest(F.col("l"), F.col("r"))).alias("name")), "blocks"))

    lengths = blocks[0].groupBy("seq").agg(F.count("*").alias("len"))
    whole = seqs.join(lengths, "seq", "left").join(blocks[-1].select("seq", "name"), "seq", "left")
    whole = written(whole.select("seq", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("name", F.lit(b"")).alias("name")), "whole")

    # Pieces: the distinct sequences of a tree. seq: one that has it; ends: the copies' smallest seq, if one ends with the piece.
    copies = whole.groupBy("name").agg(F.min("seq").alias("seq"), F.max("len").alias("len"), F.count("*").alias("n"))
    pieces = written(copies.where("len > 0").select(F.lit(least).cast("long").alias("root"), F.lit(0).cast("long").alias("depth"), "seq", "len", "n", F.col("seq").alias("ends")), "pieces")
    trees = [pieces]
    for level in range(height - 1, -1, -1):
        h = 1 << level
        cut = written(pieces.withColumn("block", F.expr(f"depth div {h}")).join(blocks[level].select("seq", "block", "name"), ["seq", "block"]), "cut")
        ended = F.max(F.when(F.col("len") <= h, F.col("ends"))).alias("ends")
        upper = written(cut.groupBy("root", "depth", "name").agg(F.min("seq").alias("seq"), F.max(F.least("len", F.lit(h))).alias("len"), F.sum("n").alias("n"), ended), "upper")
        roots = upper.select("root", "depth", "name", F.col("seq").alias("below"))
        lower = cut.where(F.col("len") > h).join(roots, ["root", "depth", "name"])
        lower = lower.select(F.col("below").alias("root"), (F.col("depth") + h).alias("depth"), "seq", (F.col("len") - h).alias("len"), "n", "ends")
        pieces = written(upper.select(*lower.columns).union(lower), "pieces")
        trees.append(pieces)
    trees.reverse()

    # A piece of a tree of height 1 is a node: its parent is the root.
    nodes = pieces.join(blocks[0].select("seq", F.col("block").alias("depth"), "bytes"), ["seq", "depth"])
    nodes = nodes.select("seq", (F.col("depth") + 1).alias("depth"), F.col("root").alias("parent"), "n", "bytes", "ends")
    root_ends = F.min(F.when(F.col("len") == 0, F.col("seq")))
    top = whole.agg(F.min("seq").alias("seq"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("n"), F.lit(0).cast("long").alias("bytes"), root_ends.alias("ends"))
    nodes = nodes.union(top.where("seq IS NOT NULL"))
    kids = pieces.groupBy(F.col("root").alias("seq"), "depth").agg(F.count("*").alias("children"))
    nodes = nodes.join(kids, ["seq", "depth"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    nodes = written(nodes.withColumn("leaves", (F.col("children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("bytes")), "nodes")

    grafts: list[DataFrame] = []
    own, above = nodes.select("seq", "depth", "leaves", "saved"), None
    for level in range(height + 1 if longest is not None else 0):
        h = 1 << level
        if level == 0:
            above = nodes.where("depth > 0").select("seq", "depth", F.col("parent").alias("up"), (F.col("depth") - 1).alias("up_depth"))
        else:
            # Links of half the height, and those of the node at their end.
            links = trees[level - 1].where((F.col("len") == h // 2) & ((F.col("depth") + h // 2) % h == 0))
            links = links.select("seq", (F.col("depth") + h // 2).alias("depth"), F.col("root").alias("mid"), F.col("depth").alias("mid_depth"))
            further = above.select(F.col("seq").alias("mid"), F.col("depth").alias("mid_depth"), "up", "up_depth")
            further = links.join(further, ["mid", "mid_depth"]).select("seq", "depth", "up", "up_depth")
            above = written(above.where(F.col("depth") % h == 0).union(further), "above")
        odd = (F.col("depth") % (2 * h) == h) & (F.col("depth") > 0)
        sums = _sum_of([own, *grafts]) if grafts else own
        grafted = sums.where(odd).join(above.where(odd), ["seq", "depth"])
        grafts.append(written(grafted.groupBy(F.col("up").alias("seq"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "grafts"))

    total = _sum_of([own, *grafts])
    ends = _ends(whole.select("name", "seq"))
    out = nodes.drop("leaves", "saved").join(total, ["seq", "depth"]).join(ends, "ends", "left")
    return out.select(F.col("seq").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))

"""Tokenizing documents and packing them into sequences by best-two-fit.

Pieces are dealt by hash, and equal pieces evenly, into groups of bounded size; each group is packed by itself, which costs less
than one sequence a group. A bin is filled greedily with the largest pieces that fit; then its smallest
piece gives way to two unpacked ones if they fill the gap that it leaves more tightly.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import bounded_batches, unused

CAPACITY, SEPARATOR_ID = 2048, 0
#: Pieces of a group, about; bytes of text that a piece stands for in this estimate.
GROUP_PIECES, PIECE_BYTES = 20_000, 6_000
#: A worker forgets its words beyond so many words or ids.
CACHE_WORDS, CACHE_IDS = 600_000, 6_000_000
#: Words that are encoded in one call, joined by spaces; each id's place tells its word.
LEARN_WORDS = 4096


class _Encoder:
    """Token ids of words, each encoded once in a Python worker.

    The tokenizer must treat words apart: white space separates and is dropped.
    """

    made: dict[str, _Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        """Forgets all words: keys are their sorted hashes, rows their places in begin, sizes and flat."""
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.sizes, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    @classmethod
    def of(cls, path: str) -> _Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        sizes, flat = [self.sizes], [self.flat]
        for k in range(0, len(texts), LEARN_WORDS):
            part = texts[k : k + LEARN_WORDS]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(t) + 1 for t in part[:-1])])
            first = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            sizes.append(np.bincount(np.searchsorted(starts, first, side="right") - 1, minlength=len(part)).astype(np.int32))
            flat.append(np.array(found.ids, self.flat.dtype))
        at = np.searchsorted(self.keys, keys)
        self.rows = np.insert(self.rows, at, np.arange(len(self.sizes), len(self.sizes) + len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)

    def ids(self, w: textops.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each document's ids begin and end."""
        distinct, first, which = np.unique(textops.word_hashes(w), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        new = place == len(self.keys)
        new[~new] = self.keys[place[~new]] != distinct[~new]
        if new.any():
            at, raw = first[new], w.data.tobytes()
            self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
        word = self.rows[np.searchsorted(self.keys, distinct)][which]
        counts, begin = self.sizes[word].astype(np.int64), (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[word]
        ends = np.cumsum(counts)
        at = np.repeat(begin - (ends - counts), counts) + np.arange(int(counts.sum()))
        return self.flat[at], np.append(0, ends)[w.first]


_PIECES = "piece int, start long, length long, ids binary"


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id_col, piece (from 0), start, length and ids (little-endian unsigned 32-bit).

    A document is the ids of its text and the separator id; only documents of more than capacity ids are
    cut, into pieces of capacity ids, the last one shorter. Null and empty texts are the separator alone.
    """
    kind = T.StructType([docs.select(id_col).schema[0], *T._parse_datatype_string(_PIECES).fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(tokenizer_path)
        for batch in batches:
            data, offsets = textops.utf8_column(batch["text"])
            for i, j in textops.chunks(offsets):
                ids, cuts = encoder.ids(textops.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                rows: list[tuple] = []
                for d in range(j - i):
                    own = np.append(ids[cuts[d] : cuts[d + 1]], np.uint32(SEPARATOR_ID)).astype("<u4")
                    rows += [(i + d, p, a, min(capacity, len(own) - a), own[a : a + capacity].tobytes()) for p, a in enumerate(range(0, len(own), capacity))]
                of, piece, start, length, raw = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary())], names=[id_col, "piece", "start", "length", "ids"])

    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, kind)


def best_two_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every item; lengths are from 1 to capacity."""
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stock[lengths[i]].append(i)
    there = sum(1 << n for n, items in enumerate(stock) if items)  # bit n: an item of length n is unpacked
    bins, offsets = [0] * len(lengths), [0] * len(lengths)

    def largest(most: int) -> int:
        return (there & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(n: int) -> int:
        nonlocal there
        item = stock[n].pop()
        if not stock[n]:
            there ^= 1 << n
        return item

    def pair(gap: int, above: int) -> tuple[int, int] | None:
        """Two lengths whose sum is largest, over above and at most gap."""
        best, a = None, largest(gap - 1)
        while a > 0 and 2 * a > above:
            b = largest(min(gap - a, a if len(stock[a]) > 1 else a - 1))
            if b > 0 and a + b > above:
                best, above = (a, b), a + b
                if above == gap:
                    break
            a = largest(a - 1)
        return best

    at = 0
    while there:
        mine, gap = [], capacity
        while (n := largest(gap)) > 0:
            mine.append(take(n))
            gap -= n
        while gap and (two := pair(gap + lengths[mine[-1]], lengths[mine[-1]])):
            out = mine.pop()
            mine += [take(two[0]), take(two[1])]
            gap += lengths[out] - sum(two)
            stock[lengths[out]].append(out)
            there |= 1 << lengths[out]
            mine.sort(key=lambda i: -lengths[i])
        place = 0
        for i in mine:
            bins[i], offsets[i] = at, place
            place += lengths[i]
        at += 1
    return bins, offsets


def deal(pieces: DataFrame, groups: int, group: str = "pack_group", times: str = "pack_times") -> DataFrame:
    """Distinct pieces with their group and times, how many of the equal pieces the group has; no piece has such columns."""
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    n, first, j = unused([*pieces.columns, group, times], "n", "first", "j")
    counted = pieces.groupBy(*columns).agg(F.count("*").alias(n)).withColumn(first, F.pmod(F.xxhash64(*columns), F.lit(groups)))
    spread = counted.withColumn(j, F.explode(F.sequence(F.lit(0), F.least(F.col(n), F.lit(groups)).cast("int") - 1)))
    each = F.expr(f"{n} div {groups} + if({j} < {n} % {groups}, 1, 0)")
    return spread.select(*columns, ((F.col(first) + F.col(j)) % groups).alias(group), each.alias(times))


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a length from 1 to capacity) and their sequence_id and offset, gapless from 0.

    Pieces are dealt into groups by a hash of their columns, equal pieces evenly over all groups from there on;
    equal pieces are counted first, so they never meet in one task. Columns named sequence_id or offset are
    replaced; others pass through whatever their names. Keep them narrow.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    group, times = unused(columns, "pack_group", "pack_times")
    dealt = deal(pieces.select(*(F.col(f"`{c}`") for c in columns)), groups, group, times)
    kind = T.StructType([*(pieces.schema[c] for c in columns), *T._parse_datatype_string("sequence_id long, offset long").fields])

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in columns])
        table = table.take(pa.array(np.repeat(np.arange(len(table)), table[times].to_numpy())))
        bins, offsets = best_two_fit(table["length"].to_pylist(), capacity)
        first = table[group][0].as_py() << 32
        out = table.select(columns).append_column("sequence_id", pa.array([first + b for b in bins], pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy(group).applyInArrow(fill, kind)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """tokenize() and pack(): id_col, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    pieces = tokenize(docs, tokenizer_path, id_col, text_col, capacity).select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, max(1, math.ceil((rows + size / PIECE_BYTES) / GROUP_PIECES)), capacity)

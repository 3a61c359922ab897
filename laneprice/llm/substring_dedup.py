"""Substring dedup with fixed-block anchors.

Every document lives in one home, a group of documents of bounded size chosen by hash. Three passes
over the homes, whose texts are shuffled once, exchange only packed hashes and bitmaps:

1. Anchors. Non-overlapping reference blocks of (min_words + 1) // 2 words are indexed and every
   rolling window of that length probes them. Any run of min_words words holds a whole block, so
   both ends of an exact repeat contain a block that hits.
2. Extension. Only runs of min_words words around a hit go on; 128 bits of two hashes of the whole run,
   formed over different word hashes, decide whether it starts anywhere else. Adjoining repeated runs make
   up the maximal exact repeats.
3. Removal. Words under a maximal repeat go.

A home sends each distinct hash once, whatever its number of copies, so a passage that a third of
all documents share costs one entry per home and no pairs are ever formed. There are as many buckets as
the text needs at BUCKET_BYTES each. Rows that repeat in id and text are folded into one that counts
double, so they don't meet in one home.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import cut, repeated, unused

#: Text of a home, and text behind one bucket of hashes.
HOME_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: So many kinds of rows that repeat in id and text may be broadcast.
BROADCAST_KINDS = 200_000

_PACKED = "bucket long, home long, width int, hashes binary, flags binary"
_REPLY = "home long, bucket long, bits binary"
#: Bucket of the row that carries a home's own anchor hits on to the last pass.
_OWN = -1


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, arrow[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs: where one of each kind is, in order, and the kind of each pair."""
    order = np.lexsort((b, a))
    edge = np.ones(len(order), dtype=bool)
    edge[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(edge) - 1
    return order[edge], which


class _Home:
    """Words and hashes of the documents of one home, chunk by chunk."""

    def __init__(self, texts: pa.Table, min_words: int, buckets: int):
        self.min_words, self.block, self.buckets = min_words, (min_words + 1) // 2, np.uint64(buckets)
        data, offsets = textops.utf8_column(texts["text"])
        twice = 1 + (texts["times"].to_numpy() > 1)  # what a document's windows count
        self.twice = [twice[i:j] for i, j in textops.chunks(offsets)]
        self.parts = [textops.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in textops.chunks(offsets)]
        self.hashes = [textops.word_hashes(w) for w in self.parts]

    def anchors(self):
        """Distinct probe keys in order, which are repeated here, which are of reference blocks, and each probe's key."""
        at, keys, aligned, weight = [], [], [], []
        for w, h, twice in zip(self.parts, self.hashes, self.twice, strict=True):
            here, grams = textops.gram_hashes(h, w, self.block)
            docs = w.docs[here]
            at.append(here)
            keys.append(((grams >> np.uint64(32)) % self.buckets << np.uint64(32)) | (grams & np.uint64(0xFFFFFFFF)))
            aligned.append((here - w.first[docs]) % self.block == 0)
            weight.append(twice[docs])
        self.at = at
        found, which = np.unique(np.concatenate(keys), return_inverse=True)
        reference = np.zeros(len(found), dtype=bool)
        reference[which[np.concatenate(aligned)]] = True
        return found, np.bincount(which, weights=np.concatenate(weight), minlength=len(found)) > 1, reference, which

    def runs(self, hits: np.ndarray):
        """Runs of min_words words with a hit inside: positions by chunk, distinct hash pairs by bucket, repeated or not, each run's pair."""
        at, hashes, others, weight, seen = [], [], [], [], 0
        for w, h, here, twice in zip(self.parts, self.hashes, self.at, self.twice, strict=True):
            before = np.zeros(len(h) + 1, dtype=np.int64)
            before[1:][here] = hits[seen : seen + len(here)]
            np.cumsum(before, out=before)
            seen += len(here)
            start, grams = textops.gram_hashes(h, w, self.min_words)
            near = before[start + self.min_words - self.block + 1] > before[start]
            at.append(start[near])
            hashes.append(grams[near])
            weight.append(twice[w.docs[start[near]]])
            if near.any():
                others.append(textops.gram_hashes(textops.word_hashes(w, values=textops.OTHER_VALUES), w, self.min_words)[1][near])
        pairs = np.stack((np.concatenate(hashes), np.concatenate([*others, np.zeros(0, np.uint64)])), axis=1)
        one, which = _distinct(pairs[:, 0], pairs[:, 1])
        counts = np.bincount(which, weights=np.concatenate(weight), minlength=len(one))
        order = np.argsort((pairs[one, 0] >> np.uint64(32)) % self.buckets, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return at, pairs[one[order]], counts[order] > 1, place[which]


def _by_bucket(home: int, bucket: np.ndarray, hashes: np.ndarray, *flags: np.ndarray) -> list[tuple]:
    """One row for each bucket that has hashes; bucket is sorted."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] ^ np.uint64(1))) if len(bucket) else []
    return [(int(bucket[i]), home, hashes[i].nbytes, hashes[i:j].tobytes(), b"".join(_bits(f[i:j]) for f in flags)) for i, j in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]


def _whole(replies: pa.Table, hashes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The replies of all buckets, in the order of the hashes that were sent."""
    sent = {k: n for k, n in zip(*np.unique(bucket, return_counts=True), strict=True)}
    out = {k: _flags(bits, sent[k]) for k, bits in zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist(), strict=True) if k in sent}
    return np.concatenate([out[k] for k in sorted(out)]) if out else np.zeros(0, dtype=bool)


def _repeated(table: pa.Table) -> pa.Table:
    """For one bucket: which hashes of each home have a reference block and occur twice or more in all."""
    rows = list(zip(*(table[c].to_pylist() for c in ("home", "width", "hashes", "flags")), strict=True))
    sizes = [len(x) // w for _, w, x, _ in rows]
    half = [(n + 7) // 8 for n in sizes]
    many = np.concatenate([_flags(f[:k], n) for (_, _, _, f), k, n in zip(rows, half, sizes, strict=True)])
    reference = np.concatenate([_flags(f[k:], n) for (_, _, _, f), k, n in zip(rows, half, sizes, strict=True)])
    if rows[0][1] == 4:
        _, which = np.unique(np.concatenate([np.frombuffer(x, "<u4") for _, _, x, _ in rows]), return_inverse=True)
    else:
        _, which = _distinct(*np.concatenate([np.frombuffer(x, "<u8").reshape(-1, 2) for _, _, x, _ in rows]).T)
    indexed = np.zeros(which.max() + 1, dtype=bool)
    indexed[which[reference]] = True
    found = (indexed & (np.bincount(which, weights=1 + many) >= 2))[which]
    bucket = table["bucket"][0].as_py()
    return _table([(rows[k][0], bucket, _bits(x)) for k, x in enumerate(np.split(found, np.cumsum(sizes)[:-1]))], _REPLY)


def _kept(w: textops.Words, gone: np.ndarray) -> list[str]:
    """Each document's words that stay, joined by one space."""
    keep = ~gone
    starts, sizes = w.starts[keep], (w.ends - w.starts)[keep]
    ends = np.cumsum(sizes + 1)  # of the kept words in the joined bytes, one space behind each
    at = np.repeat(starts - (ends - sizes - 1), sizes + 1) + np.arange(int(sizes.sum()) + len(sizes))
    raw = np.append(w.data, np.uint8(0))[at]
    raw[ends - 1] = 0x20
    joined = raw.tobytes()
    bounds = np.append(0, ends)[np.append(0, np.cumsum(keep))[w.first]]
    return [joined[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35, home_bytes: int = HOME_BYTES) -> DataFrame:
    """Removes every word under a run of min_words words that also starts anywhere else.

    One row per input row: id_col, n_words, n_removed, kept_text (the words that stay, joined by one
    space) and removed_spans (maximal removed runs as word positions, end exclusive). Runs are judged on
    the input. Null or empty texts have no words and give empty kept_text. Rows that repeat count as
    separate documents, so each finds the other. Ids may be null or repeat. Other columns are ignored.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = rows.groupBy(F.xxhash64("id", "text").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    size, most = kinds.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > 1:
        hot = cut(kinds.where(F.col("n") > 1).select("kind"))
        hot = F.broadcast(hot) if hot.count() <= BROADCAST_KINDS else hot
        keyed = rows.withColumn("kind", F.xxhash64("id", "text"))
        folded = keyed.join(hot, "kind", "left_semi").groupBy("id", "text").agg(F.count("*").alias("times"))
        rows = keyed.join(hot, "kind", "left_anti").select("id", "text", F.lit(1).cast("long").alias("times")).union(folded)
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    homes, buckets = max(1, math.ceil(size / home_bytes)), max(1, math.ceil(size / BUCKET_BYTES))
    homed = rows.withColumn("home", F.pmod(F.xxhash64("id", "text"), F.lit(homes)))
    times, number = unused([id_col], "times", "number")

    def load(texts: pa.Table) -> _Home:
        return _Home(texts, min_words, buckets)

    def probe(texts: pa.Table) -> pa.Table:
        keys, many, reference, _ = load(texts).anchors()
        return _table(_by_bucket(texts["home"][0].as_py(), keys >> np.uint64(32), keys.astype(np.uint32), many, reference), _PACKED)

    def extend(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(texts):
            return _table([], _PACKED)
        home, own = load(texts), texts["home"][0].as_py()
        keys, _, _, which = home.anchors()
        hits = _whole(replies, keys, keys >> np.uint64(32))
        _, hashes, many, _ = home.runs(hits[which])
        rows = _by_bucket(own, (hashes[:, 0] >> np.uint64(32)) % home.buckets, hashes, many, np.ones(len(hashes), dtype=bool))
        return _table([*rows, (_OWN - own, own, 0, _bits(hits), b"")], _PACKED)

    def settle(packed: pa.Table) -> pa.Table:
        if packed["bucket"][0].as_py() < 0:
            return _table(list(zip(packed["home"].to_pylist(), [_OWN] * len(packed), packed["hashes"].to_pylist(), strict=True)), _REPLY)
        return _repeated(packed)

    def remove(texts: pa.Table, replies: pa.Table) -> pa.Table:
        home = load(texts)
        keys, _, _, which = home.anchors()
        own = [b for k, b in zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist(), strict=True) if k == _OWN]
        at, hashes, _, run = home.runs(_flags(own[0], len(keys))[which])
        again = _whole(replies, hashes, (hashes[:, 0] >> np.uint64(32)) % home.buckets)[run]
        seen, counts, removed, kept, spans = 0, [], [], [], []
        for w, here in zip(home.parts, at, strict=True):
            cover = np.zeros(len(w.starts) + 1, dtype=np.int64)
            start = here[again[seen : seen + len(here)]]
            seen += len(here)
            cover[start] += 1
            np.subtract.at(cover, start + min_words, 1)
            gone = np.cumsum(cover[:-1]) > 0
            counts.append(w.counts)
            removed.append(textops.sums_by_doc(gone, w.first))
            kept += _kept(w, gone)
            docs_of = w.docs
            edge = np.ones(len(gone), dtype=bool)
            edge[1:] = (gone[1:] != gone[:-1]) | (docs_of[1:] != docs_of[:-1])
            begin = np.flatnonzero(edge)
            end = np.append(begin[1:], len(gone))[gone[begin]] if len(begin) else begin
            begin = begin[gone[begin]]
            of = docs_of[begin]
            each = [[] for _ in range(len(w.first) - 1)]
            for d, a, b in zip(of.tolist(), (begin - w.first[of]).tolist(), (end - w.first[of]).tolist(), strict=True):
                each[d].append({"start": a, "end": b})
            spans += each
        return pa.table(
            [texts["id"].combine_chunks(), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(removed)), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), texts["times"]],
            names=[id_col, "n_words", "n_removed", "kept_text", "removed_spans", times],
        )

    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(f"n_words long, n_removed long, kept_text string, removed_spans array<struct<start:long,end:long>>, {times} long").fields])
    by_home = homed.groupBy("home")
    anchors = by_home.applyInArrow(probe, _PACKED).groupBy("bucket").applyInArrow(_repeated, _REPLY)
    runs = by_home.cogroup(anchors.groupBy("home")).applyInArrow(extend, _PACKED).groupBy("bucket").applyInArrow(settle, _REPLY)
    done = by_home.cogroup(runs.groupBy("home")).applyInArrow(remove, out)
    return (repeated(done, times, number) if most > 1 else done).select(id_col, "n_words", "n_removed", "kept_text", "removed_spans")

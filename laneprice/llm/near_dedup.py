"""Near-duplicate classes with circulant MinHash, banding and exact Jaccard verification.

Two permutations of a fixed universe make every signature coordinate: the first scatters the shingles,
the second, shifted circularly by k, orders them for coordinate k. Signatures are cut into bands.

Documents with equal shingle sets are folded into one node before anything else, so copies cost one row
of the tables below, whatever their number. Inside a band's bucket a node is compared with one leader,
not with all others; a further round takes another leader for buckets whose nodes are still in several
components, and a last round checks what is left: nodes of such buckets meet only if they share one of
their rarest shingles, and become a pair only if they are of different components and their sizes and the
parity sketches of their sets allow a link. Linked sets share one of their rarest shingles, and two sets
differ in at least as many shingles as their sketches in bits (each tells whether an odd number of
shingles falls on it): neither drops a link. So no pair of different components that share a bucket goes
unchecked, and texts on one template, whose rare shingles are their own, don't meet.
Every link is confirmed on the full shingle sets. A pair at exactly the threshold shares no bucket with
probability (1 - t ** ROWS) ** BANDS, 5e-6 for 0.8.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .components import connected_components
from .shared import bounded_batches, cut, written

BANDS, ROWS = 40, 6
#: Places of the universe that shingles are scattered over.
UNIVERSE = 1 << 20
#: 64-bit words of a parity sketch.
SKETCH = 16
#: Candidate rows (24 bytes each) that may be broadcast to pick their texts; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bits of a node's number. Sets whose numbers are equal are told apart by 64 further bits.
NODE_BITS = 64
_SHORT = np.uint64(0xA24BAED4963EE407)


class _Permutations:
    """The two permutations, made once in a Python worker."""

    made = None

    def __new__(cls):
        if cls.made is None:
            rng = np.random.default_rng(97)
            first, second = rng.permutation(UNIVERSE), rng.permutation(UNIVERSE).astype(np.int32)
            shifted = np.concatenate((second, second[: BANDS * ROWS]))
            cls.made = first, np.lib.stride_tricks.sliding_window_view(shifted, BANDS * ROWS)
        return cls.made


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text, A-Z in lower case."""
    data, offsets = textops.utf8_column(texts)
    for i, j in textops.chunks(offsets):
        w = textops.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hashes = textops.word_hashes(w, lower=True)
        at, grams = textops.gram_hashes(hashes, w, size)
        cuts = np.searchsorted(at, w.first)
        for d, n in enumerate(w.counts.tolist()):
            if n >= size:
                yield np.unique(grams[cuts[d] : cuts[d + 1]])
            elif n:
                own = textops.Words(w.data, w.offsets, w.starts, w.ends, w.first[d : d + 2])
                yield textops.gram_hashes(hashes, own, n)[1] ^ (_SHORT * np.uint64(n))
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash of a set that isn't empty."""
    first, shifted = _Permutations()
    place = first[(shingles % np.uint64(UNIVERSE)).astype(np.int64)]
    out = None
    for i in range(0, len(place), 8192):
        least = shifted[place[i : i + 8192]].min(axis=0)
        out = least if out is None else np.minimum(out, least)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).astype(np.uint64).T:
        keys = textops.mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    bits = np.bincount((shingles >> np.uint64(24)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _may_link(percent: int) -> str:
    """Whether the sketches of a and b allow a link: at most (100 - percent) / (100 + percent) of both sizes may differ."""
    apart = " + ".join(f"bit_count(a{i} ^ b{i})" for i in range(SKETCH))
    return f"({apart}) * {100 + percent} <= (size_a + size_b) * {100 - percent}"


_SIGNED = "text_hash long, n_shingles long, node long, other long, bands array<long>, sketch array<long>"


def _signed(size: int, bits: int):
    """Rows with the node, 64 other bits of the same digest, bands and sketch of their text's shingle set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for shingles in shingle_sets(batch["text"], size):
                counts.append(len(shingles))
                if len(shingles):
                    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                    node, other = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
                    found.append((node >> (64 - bits), other, band_keys(signature(shingles)).view(np.int64), parity_sketch(shingles)))
                else:
                    found.append((None,) * 4)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            made = [pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [[]] * 4, kinds, strict=True)]
            names = ["id", *(x.split()[0] for x in _SIGNED.split(", "))]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["text_hash"], pa.array(counts, pa.int64()), *made], names=names)

    return sign


def _told_apart(signed: DataFrame) -> DataFrame:
    """signed, where different sets never share a node: nodes of several sets are numbered anew, by all 128 bits."""
    several = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y"))
    several = cut(several.where("x < y").select(F.col("node").alias("shared")))
    if several.isEmpty():
        return signed
    few = several.count() <= BROADCAST_ROWS
    joined = signed.join(F.broadcast(several) if few else several, F.col("node") == F.col("shared"), "left")
    anew = F.when(F.col("shared").isNotNull(), F.xxhash64("node", "other")).otherwise(F.col("node"))
    return written(joined.withColumn("node", anew).drop("shared"), "signed")


def _confirm(size: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(shingle_sets(batch["text_a"], size), shingle_sets(batch["text_b"], size), strict=True):
                short, long = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * short >= percent * long else 0
                linked.append(100 * both >= percent * (short + long - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return confirm


def _listed(size: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch["text"], size)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch["node"], lists], names=["node", "tokens"])

    return listed


def _rarest(nodes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, component, token, few: the rarest shingles of every node (node, component), and those (few) that are enough towards a set as large or larger.

    Shingles are ordered by how many of these nodes have them. Of two linked sets the smaller, of n, shares at least
    2 * percent * n / (100 + percent) with the other, and the larger percent * n / 100 of its own n; so one of the
    first of each that may be lacking, and one more, is common to both. Tokens that bring no pair of different
    components are left out.
    """
    lists = bounded_batches(texts.join(nodes.select("node"), "node", "left_semi").select("node", "text")).mapInArrow(_listed(shingle), "node long, tokens array<long>")
    tokens = written(lists.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token")), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "token"))
    # n less the least that is shared, and one: the quotients round the least up.
    first = tokens.join(often, "token").withColumn("place", place).where(F.expr(f"place <= n * {100 - percent} div 100 + 1 AND often > 1"))
    few = F.expr(f"place <= n * {100 - percent} div {100 + percent} + 1")
    first = cut(first.select("node", "token", few.alias("few")).join(nodes, "node"))
    several = first.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.bool_or("few").alias("few")).where("x < y AND few").select("token")
    return first.join(several, "token")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, groups: bool = False) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id and kept; with groups also text_hash and group.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id
    is the smallest id of a component, kept marks the rows that carry it. A text with fewer words than a
    shingle is one shingle as a whole. Null and empty texts, and texts without words, have no shingles,
    are linked with nothing and stand for themselves. Null ids don't count for the smallest id; a
    component of null ids alone has a null id and keeps its rows. Rows that repeat an id count one by
    one. Other columns are ignored. group tells components apart even where ids repeat, and is null for
    texts without shingles; text_hash is xxhash64 of the text. percent below 60 needs more bands than this
    signature has.
    """
    if shingle < 1 or not 60 <= percent <= 100:
        raise ValueError("shingle must be at least 1 and percent from 60 to 100")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(_SIGNED).fields])
    signed = _told_apart(written(bounded_batches(rows).mapInArrow(_signed(shingle, NODE_BITS), kind), "signed"))

    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "n_shingles", "bands", "sketch")).alias("rep")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(first)
    nodes = written(nodes.select("node", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "rep.n_shingles", "rep.bands", "rep.sketch"), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    shared = written(buckets.join(leaders, "key"), "buckets")

    sketches = nodes.select("node", "n_shingles", "sketch")
    picked = cut(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "rep_id", "rep_hash"))
    few = picked.count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(picked) if few else picked, F.expr("rep_hash = text_hash AND rep_id <=> id"))
    texts = written(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")  # rows that repeat give one

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return cut(bounded_batches(both.select("a", "b", "text_a", "text_b")).mapInArrow(_confirm(shingle, percent), "a long, b long"))

    links = confirmed(shared.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    # Sizes of linked sets differ by the ratio 100 / percent at most, so their logarithms fall into the same or the next step.
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else None
    size = F.col("n_shingles") if step is None else F.floor(F.ln("n_shingles") / step)
    near = F.array(size) if step is None else F.sequence(size - 1, size + 1)

    def allowed(left: DataFrame, right: DataFrame, on: str, apart: str) -> DataFrame:
        """a, b: nodes of left and right that share on and whose components, sizes and sketches allow a link."""

        def side(df: DataFrame, x: str, level) -> DataFrame:
            bits = (F.col("sketch")[i].alias(f"{x}{i}") for i in range(SKETCH))
            return df.select(on, level.alias("level"), F.col("node").alias(x), F.col("component").alias(f"component_{x}"), F.col("n_shingles").alias(f"size_{x}"), *bits)

        a, b = side(left, "a", size), side(right, "b", F.explode(near))
        pairs = a.join(b, (a[on] == b[on]) & (a["level"] == b["level"]) & F.expr(apart) & F.expr(_may_link(percent)))
        return pairs.select("a", "b").distinct()

    for last in (False, True):
        labels = connected_components(links)
        placed = shared.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(F.struct(F.xxhash64("node", "key"), "node")).alias("next"))
        open_keys = cut(open_keys.where("x < y").select("key", F.col("next.node").alias("leader")))
        if open_keys.isEmpty():
            break
        members = placed.join(open_keys, "key")
        if not last:
            members = written(members.join(sketches, "node"), "members")
            pairs = allowed(members, members.where("node = leader"), "key", "component_a <> component_b")
        else:
            rare = _rarest(cut(members.select("node", "component").distinct()), texts, shingle, percent)
            rare = written(rare.join(sketches, "node"), "members")
            smaller = "component_a <> component_b AND (size_a < size_b OR size_a = size_b AND a < b)"
            pairs = allowed(rare.where("few"), rare, "token", smaller)
        links = cut(links.union(confirmed(pairs)))
    labels = connected_components(links)

    placed = nodes.select("node", "rep_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Written first, so that the join below, where one component may hold a third of the nodes, can be split.
    least = cut(placed.groupBy("component").agg(F.min("rep_id").alias("component_id")))
    placed = placed.join(least, "component").select("node", "component_id", "component")
    found = signed.where("node IS NOT NULL").join(placed, "node").select("id", "n_shingles", "component_id", "text_hash", "component")
    alone = signed.where("node IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"), "text_hash", F.lit(None).cast("long").alias("component"))
    more = ["text_hash", F.col("component").alias("group")] if groups else []
    return found.union(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.expr("id <=> component_id").alias("kept"), *more)

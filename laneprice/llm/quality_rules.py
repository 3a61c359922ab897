"""Quality rules: text statistics, and a calibrated logistic regression on hashed n-grams.

The model sees word 1- and 2-grams and character 3- and 4-grams, each hashed to one of DIMENSIONS
weights. It is fitted in one task on a bounded sample of labelled rows (sample_rows, chosen by hash),
calibrated on the part held out, and scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from . import textops
from .shared import bounded_batches, unused

DIMENSIONS = 1 << 18
WORD_GRAMS, CHAR_GRAMS = (1, 2), (3, 4)
#: Mean weight of a text's n-grams times SCALE is its logit.
SCALE = 60.0
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 4000
HELD_OUT = 4  # one row in so many calibrates
STEPS, RATE, DECAY = 50, 0.1, 1e-5
#: Bytes of text whose n-grams are held at a time.
SCORED_BYTES = 1 << 18
#: A text is kept from this calibrated probability of good quality on.
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def _grams(w: textops.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per kind: weight index of every n-gram, and where each document's n-grams begin and end."""
    hashes = textops.word_hashes(w)
    for n in WORD_GRAMS:
        at, grams = textops.gram_hashes(hashes, w, n)
        yield (grams % np.uint64(DIMENSIONS)).astype(np.int32), np.searchsorted(at, w.first)
    lead = (w.data & 0xC0) != 0x80
    first = np.concatenate(([0], np.cumsum(lead)))[w.offsets]
    points = np.frombuffer(w.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    whole = textops.Words(w.data, w.offsets, points, points, first)
    spread = textops.mix(points + np.uint64(0x51ED270B))
    for n in CHAR_GRAMS:
        at, grams = textops.gram_hashes(spread, whole, n)
        yield (textops.mix(grams + np.uint64(n)) % np.uint64(DIMENSIONS)).astype(np.int32), np.searchsorted(at, first)


def _logits(w: textops.Words, model: Model) -> np.ndarray:
    total = np.full(len(w.first) - 1, model.bias)
    for index, cuts in _grams(w):
        sums = np.concatenate(([0.0], np.cumsum(model.weights[index], dtype=np.float64)))
        total += SCALE / 4 * (sums[cuts[1:]] - sums[cuts[:-1]]) / np.maximum(np.diff(cuts), 1)
    return total


def _probability(logits: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * logits + model.offset, -50, 50)))


def _parts(column: pa.Array) -> Iterator[textops.Words]:
    data, offsets = textops.utf8_column(column)
    for i, j in textops.chunks(offsets, SCORED_BYTES):
        yield textops.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def statistics(w: textops.Words) -> dict[str, np.ndarray]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of every document."""
    n, docs = len(w.data), len(w.first) - 1
    by_byte = lambda flags: textops.sums_by_doc(flags, w.offsets)
    lead = (w.data & 0xC0) != 0x80
    out = {"n_words": w.counts.astype(np.int64), "word_chars": by_byte(lead & ~textops._IS_SEPARATOR[w.data]), "n_symbols": by_byte(_SYMBOL[w.data])}

    breaks = np.flatnonzero(w.data == 10)
    starts = np.union1d(w.offsets[:-1], breaks + 1)
    starts = starts[starts < n]
    of = np.searchsorted(w.offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, n)[np.searchsorted(breaks, starts)], w.offsets[of + 1])
    filled = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, of = starts[filled], ends[filled], of[filled]
    own = lambda hashes, d: textops.mix(hashes + textops.mix(d.astype(np.uint64) + np.uint64(1)))
    _, seen = np.unique(own(textops.span_hashes(w.data, starts, ends), of), return_index=True)
    out["n_dup_lines"] = np.bincount(of, minlength=docs) - np.bincount(of[seen], minlength=docs)

    at, grams = textops.gram_hashes(textops.word_hashes(w), w, REPEAT_WINDOW)
    _, which, counts = np.unique(own(grams, w.docs[at]), return_inverse=True, return_counts=True)
    again = at[counts[which] > 1]
    cover = np.zeros(len(w.starts) + 1, dtype=np.int64)
    cover[again] += 1
    np.subtract.at(cover, again + REPEAT_WINDOW, 1)
    out["n_repeat_words"] = textops.sums_by_doc(np.cumsum(cover[:-1]) > 0, w.first)
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct weight indexes and values of labelled texts."""
    for batch in batches:
        index, value = [], []
        for w in _parts(batch["text"]):
            kinds = list(_grams(w))
            for d in range(len(w.first) - 1):
                each = [(i[c[d] : c[d + 1]], SCALE / 4 / max(1, c[d + 1] - c[d])) for i, c in kinds]
                found, which = np.unique(np.concatenate([i for i, _ in each]), return_inverse=True)
                index.append(found.astype(np.int32))
                value.append(np.bincount(which, weights=np.concatenate([np.full(len(i), v) for i, v in each]), minlength=len(found)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["id", "label", "index", "value"])


class _Rows:
    """Labels and sparse rows in blocks, so that what a product needs beside them stays small."""

    def __init__(self):
        self.label, self.blocks = np.zeros(0), []

    def add(self, batch: pa.RecordBatch, which: np.ndarray) -> None:
        part = batch.filter(pa.array(which))
        self.label = np.append(self.label, part["label"].to_numpy())
        self.blocks.append((part["index"].value_lengths().to_numpy(), part["index"].flatten().to_numpy(), part["value"].flatten().to_numpy()))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = [np.bincount(np.repeat(np.arange(len(n)), n), weights=weights[index] * value, minlength=len(n)) for n, index, value in self.blocks]
        return np.concatenate(sums) if sums else np.zeros(0)

    def back(self, rows: np.ndarray) -> np.ndarray:
        out, at = np.zeros(DIMENSIONS), 0
        for n, index, value in self.blocks:
            out += np.bincount(index, weights=np.repeat(rows[at : at + len(n)], n) * value, minlength=DIMENSIONS)
            at += len(n)
        return out


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows, which come ordered by id; nothing if there are none."""
    rows, apart, seen = _Rows(), _Rows(), 0
    for batch in batches:
        held = (seen + np.arange(batch.num_rows)) % HELD_OUT == 0
        rows.add(batch, ~held)
        apart.add(batch, held)
        seen += batch.num_rows
    if seen:
        yield _packed(*_trained(rows, apart))


def _trained(rows: _Rows, apart: _Rows) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, slope and offset: fitted on rows, calibrated on the rows held apart."""
    y, good = rows.label, apart.label
    if len(np.unique(good)) < 2 or len(np.unique(y)) < 2:
        # One class: no words speak against any text, the share of good rows decides.
        share = np.clip(np.append(y, good).mean(), 0.001, 0.999)
        return np.zeros(DIMENSIONS), float(np.log(share / (1 - share))), 1.0, 0.0

    def gradient(x: np.ndarray) -> np.ndarray:
        miss = 1 / (1 + np.exp(-np.clip(rows.dot(x[:-1]) + x[-1], -50, 50))) - y
        return np.append(rows.back(miss) / len(y) + DECAY * x[:-1], miss.mean())

    x = _adam(gradient, DIMENSIONS + 1, STEPS, RATE)
    logits = apart.dot(x[:-1]) + x[-1]
    n1, n0 = good.sum(), (1 - good).sum()
    target = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's smoothed targets

    def calibration(p: np.ndarray) -> np.ndarray:
        miss = 1 / (1 + np.exp(-np.clip((1 + p[0]) * logits + p[1], -50, 50))) - target
        return np.array([(miss * logits).mean(), miss.mean()])

    p = _adam(calibration, 2, 400, 0.02)
    return x[:-1], float(x[-1]), float(1 + p[0]), float(p[1])


def _packed(weights: np.ndarray, *rest: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), **{k: [v] for k, v in zip(("bias", "slope", "offset"), rest, strict=True)}})


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """id, text and label of at most sample_rows ids, one row each, chosen by hash."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most sample_rows rows
    return texts.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of label_col (1 good, 0 not) from at most sample_rows labelled rows with a text.

    Rows without id or label are left out; a repeated id counts once, with its smallest label and text, so
    sample_rows bounds the rows of the fit whatever repeats. With no usable rows, or one class only, every
    text gets the share of good rows (all good if there are none).
    """
    texts = sampled(docs, labels, id_col, text_col, label_col, sample_rows)
    kind = T.StructType([texts.schema["id"], *T._parse_datatype_string("label double, index array<int>, value array<float>").fields])
    featured = bounded_batches(texts).mapInArrow(_featured, kind).repartition(1).sortWithinPartitions("id", F.xxhash64("index"))
    rows = featured.mapInArrow(_fit, "weights binary, bias double, slope double, offset double")
    found = rows.first()
    if found is None:
        return Model(np.zeros(DIMENSIONS, np.float32), 7.0, 1.0, 0.0)
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"], found["slope"], found["offset"])


_SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def _scorer(model, keep_from: float):
    """A column function of texts; model: the broadcast model."""
    types = {"base_failed": pa.bool_(), "kept": pa.bool_(), "quality": pa.float64()}
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = {k: [] for k in names}
            for w in _parts(column):
                stats = statistics(w)
                stats["base_failed"] = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])
                stats["quality"] = _probability(_logits(w, model.value), model.value)
                stats["kept"] = ~stats["base_failed"] & (stats["quality"] >= keep_from)
                for k, v in stats.items():
                    found[k].append(v)
            made = [pa.array(np.concatenate(v) if v else [], types.get(k, pa.int64())) for k, v in found.items()]
            yield pa.StructArray.from_arrays(made, names=names)

    # Spark would else run it once for a filter and once more for the columns.
    return arrow_udf(score, _SCORED).asNondeterministic()


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """docs with the statistics, base_failed, quality (calibrated probability) and kept of every row.

    Columns of these names are replaced; any others may have any names. Null and empty texts have no words
    and fail. No row is lost. Only the text goes to Python, and only the scores come back.
    """
    names = [x.split()[0] for x in _SCORED.split(", ")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats
    (scored,) = unused(docs.columns, "scored")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    rows = bounded_batches(docs).select(*rest, _scorer(sent, keep_from)(F.col(text_col)).alias(scored))
    return rows.select(*rest, *(F.col(f"{scored}.{k}").alias(k) for k in names))

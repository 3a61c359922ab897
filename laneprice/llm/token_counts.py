"""Token counts under a unigram model, with forward scores shared along a trie.

A batch's distinct pre-tokens go into a trie, one depth after the other and all nodes of a depth at once.
Each node keeps the best score of its prefix and the number of pieces behind it, worked out once from the
nodes above, however many pre-tokens share the prefix; where a pre-token ends, its count is kept. A worker
goes on with the trie from batch to batch, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import bounded_batches

#: Mark of a pre-token's start in the pieces.
START = "▁"
#: A trie of more nodes, or more pre-tokens, is begun anew; characters behind so many use nodes that are not kept.
TRIE_NODES, KEPT_WORDS, KEPT_CHARS = 1_000_000, 500_000, 64
#: Bytes of text whose distinct pre-tokens are put into the trie at once.
INSERT_BYTES = 4 << 20


def piece_scores(model_path: str) -> tuple[dict[str, float], float]:
    """Log scores of the pieces, and of a byte: -ln(1 + rank), a byte ranking behind every piece."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {p: -math.log(1 + rank) for rank, p in enumerate(pieces)}, -math.log(1 + size)


def _points(texts: bytes) -> np.ndarray:
    """Code points of UTF-8."""
    return np.frombuffer(texts.decode().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _onward(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one code point longer."""
    return textops.mix(hashes * np.uint64(0x9E3779B97F4A7C15) + points + np.uint64(1))


class _Table:
    """Values by key; keys are sorted and added in bulk."""

    def __init__(self, **kinds):
        self.keys, self.values = np.zeros(0, np.uint64), {k: np.zeros(0, t) for k, t in kinds.items()}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, or would be, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return at, there

    def add(self, keys: np.ndarray, **values: np.ndarray) -> None:
        """keys: sorted, distinct and new."""
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        for k, v in values.items():
            self.values[k] = np.insert(self.values[k], at, v)


class Trie:
    """Forward scores of prefixes. Ties in score go to fewer pieces."""

    made: dict[str, Trie] = {}

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte, self.longest = scores, byte_score, max(map(len, scores), default=1)
        # Pieces of each length: hashes of their code points from the last to the first, in order, and scores.
        by_length: dict[int, list] = {}
        for piece, score in scores.items():
            key = np.zeros(1, np.uint64)
            for c in reversed(piece):
                key = _onward(key, np.array([ord(c)], np.uint64))
            by_length.setdefault(len(piece), []).append((int(key[0]), score))
        self.pieces = {n: tuple(np.array(c, t) for c, t in zip(zip(*sorted(own), strict=True), (np.uint64, np.float64), strict=True)) for n, own in by_length.items()}
        self.clear()

    def clear(self) -> None:
        self.nodes, self.ends = _Table(score=np.float64, pieces=np.int32), _Table(pieces=np.int64)

    @classmethod
    def of(cls, path: str) -> Trie:
        if path not in cls.made:
            cls.made[path] = cls(*piece_scores(path))
        return cls.made[path]

    def _scored(self, points: np.ndarray, ends: np.ndarray, depth: int, above: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Score and pieces of the prefixes of depth code points that end at ends; above has those of shorter ones."""
        width = 1 + sum((points[ends] > most).astype(np.int32) for most in (0x7F, 0x7FF, 0xFFFF))  # UTF-8 bytes
        best, count = above[depth - 1][0] + width * self.byte, above[depth - 1][1] + width
        grams = np.zeros(len(ends), np.uint64)
        for n in range(1, min(self.longest, depth) + 1):
            grams = _onward(grams, points[ends - n + 1])
            if n not in self.pieces:
                continue
            keys, scores = self.pieces[n]
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == grams)
            mine, more = above[depth - n][0][hit] + scores[at[hit]], above[depth - n][1][hit] + 1
            better = (mine > best[hit]) | ((mine == best[hit]) & (more < count[hit]))
            best[hit[better]], count[hit[better]] = mine[better], more[better]
        return best, count

    def _beyond(self, tail: str, best: deque) -> int:
        """Pieces of a pre-token from its last kept prefixes' (score, -pieces) on; tail: the characters behind the shortest of them."""
        for end in range(len(best), len(tail) + 1):
            n = len(tail[end - 1].encode())
            found = (best[-1][0] + n * self.byte, best[-1][1] - n)
            for back in range(1, len(best) + 1):
                if (own := self.scores.get(tail[end - back : end])) is not None:
                    found = max(found, (best[-back][0] + own, best[-back][1] - 1))
            best.append(found)
        return -best[-1][1]

    def insert(self, words: list[bytes]) -> np.ndarray:
        """Pieces of distinct pre-tokens."""
        texts = b"".join(START.encode() + x for x in words)
        points = _points(texts)
        lead = np.append(0, np.cumsum((np.frombuffer(texts, np.uint8) & 0xC0) != 0x80))
        bytes_to = np.cumsum([0, *(len(START.encode()) + len(x) for x in words)])
        first, sizes = lead[bytes_to[:-1]], np.diff(lead[bytes_to])
        out, key, alive = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64), np.arange(len(words))
        above = {0: (np.zeros(len(words)), np.zeros(len(words), np.int32))}
        for depth in range(1, int(min(sizes.max(initial=0), KEPT_CHARS)) + 1):
            alive = alive[sizes[alive] >= depth]
            ends = first[alive] + depth - 1
            key[alive] = _onward(key[alive], points[ends])
            nodes, one, which = np.unique(key[alive], return_index=True, return_inverse=True)
            at, there = self.nodes.find(nodes)
            score, pieces = np.zeros(len(nodes)), np.zeros(len(nodes), np.int32)
            score[there], pieces[there] = (self.nodes.values[k][at[there]] for k in ("score", "pieces"))
            new = ~there
            if new.any():
                word = alive[one[new]]
                own = {d: (s[word], c[word]) for d, (s, c) in above.items()}
                score[new], pieces[new] = self._scored(points, ends[one[new]], depth, own)
                self.nodes.add(nodes[new], score=score[new], pieces=pieces[new])
            above[depth] = np.zeros(len(words)), np.zeros(len(words), np.int32)
            above[depth][0][alive], above[depth][1][alive] = score[which], pieces[which]
            above.pop(depth - self.longest, None)
            done = alive[sizes[alive] == depth]
            out[done] = above[depth][1][done]
        for w in np.flatnonzero(sizes > KEPT_CHARS):
            best = deque(((above[d][0][w], -int(above[d][1][w])) for d in sorted(above)), maxlen=self.longest)
            out[w] = self._beyond((START + words[w].decode())[KEPT_CHARS - len(best) + 1 :], best)
        return out

    def counts(self, w: textops.Words) -> np.ndarray:
        """Pieces of every word."""
        distinct, first, which = np.unique(textops.word_hashes(w), return_index=True, return_inverse=True)
        if len(self.nodes.keys) > TRIE_NODES or len(self.ends.keys) > KEPT_WORDS:
            self.clear()
        _, there = self.ends.find(distinct)
        at, raw = first[~there], w.data.tobytes()
        if len(at):
            pieces = self.insert([raw[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
            self.ends.add(distinct[~there], pieces=pieces)
        return self.ends.values["pieces"][self.ends.find(distinct)[0]][which]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_pretokens and n_tokens of every row.

    Pre-tokens are the words of the whole text. Each is cut, behind its start mark, into the pieces whose
    scores add up highest; a character that no piece covers counts as its UTF-8 bytes. Null and empty
    texts count 0. Other columns are ignored.
    """
    kind = T.StructType([docs.select(id_col).schema[0], *T._parse_datatype_string("n_pretokens long, n_tokens long").fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.of(model_path)
        for batch in batches:
            data, offsets = textops.utf8_column(batch["text"])
            words, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in textops.chunks(offsets, INSERT_BYTES):
                w = textops.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                words.append(w.counts)
                tokens.append(textops.sums_by_doc(trie.counts(w), w.first))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.concatenate(words).astype(np.int64)), pa.array(np.concatenate(tokens))], names=[id_col, "n_pretokens", "n_tokens"])

    return bounded_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(count, kind)

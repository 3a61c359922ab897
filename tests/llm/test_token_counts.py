import random

import numpy as np
import pytest

from laneprice.llm import textops, token_counts
from laneprice.llm.token_counts import START, Trie, count_tokens, piece_scores

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


def brute(word, scores, byte):
    text = START + word
    best = [(0.0, 0)] + [None] * len(text)
    for j in range(1, len(text) + 1):
        n = len(text[j - 1].encode())
        best[j] = (best[j - 1][0] + n * byte, best[j - 1][1] - n)
        for i in range(j):
            if text[i:j] in scores:
                best[j] = max(best[j], (best[i][0] + scores[text[i:j]], best[i][1] - 1))
    return -best[-1][1]


def test_matches_brute_force(spark):
    scores, byte = piece_scores(PATH)
    rng = random.Random(8)
    words = ["".join(rng.choices("theingaé日#1", k=rng.randrange(1, 14))) for _ in range(300)] + ["ing" * 60, "the", "\U0001f600"]
    texts = [None, "", " \n"] + [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(50)] + [" ".join(words)]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for r in count_tokens(df, PATH).collect():
        own = (texts[r.doc_id] or "").split()
        assert (r.n_pretokens, r.n_tokens) == (len(own), sum(brute(w, scores, byte) for w in own))
    assert count_tokens(df.limit(0), PATH).collect() == []


def test_a_prefix_is_scored_once(monkeypatch):
    trie, made = Trie({START: -1.0, "a": -1.0, "ab": -1.5}, -9.0), []
    scored = trie._scored
    monkeypatch.setattr(trie, "_scored", lambda points, ends, *rest: made.append(len(ends)) or scored(points, ends, *rest))
    assert trie.insert([b"aba", b"abab", b"ab"]).tolist() == [3, 3, 2] and made == [1] * 5
    assert trie.insert([b"ababa", b"b"]).tolist() == [4, 2] and made == [1] * 7


def test_long_words_and_bounded_memory(monkeypatch):
    scores, byte = piece_scores(PATH)
    rng, trie = random.Random(2), Trie(scores, byte)
    long = ["".join(rng.choices("theingaé日#1", k=n)) for n in (62, 63, 64, 65, 66, 80, 900)] + ["ing" * 700]
    assert trie.insert([x.encode() for x in long]).tolist() == [brute(x, scores, byte) for x in long]
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 50)
    for k in range(5):  # words that share 64 characters make few nodes; their counts are bounded as well
        text = " ".join(f"{'x' * 70}{k}{i}" for i in range(40)).encode()
        assert len(trie.counts(textops.words(np.frombuffer(text, np.uint8), np.array([0, len(text)])))) == 40
    assert len(trie.ends.keys) <= 90 and len(trie.nodes.keys) < 2000

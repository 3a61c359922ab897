import random
import re
from collections import Counter

from laneprice.llm import substring_dedup as substring
from laneprice.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, n):
    docs = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(d[i : i + n]) for d in docs for i in range(len(d) - n + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - n + 1):
            if seen[tuple(d[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((len(d), sum(gone), " ".join(w for w, g in zip(d, gone) if not g)))
    return out


def run(spark, texts, n, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, home string, bucket int")
    return df, {r.doc_id: r for r in substring_dedup(df, min_words=n, **more).collect()}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    passage = " ".join(rng.choices("abcdefgh", k=12))
    texts = [None, "", "  \n", "one", "é ü  ß\nx"]
    for _ in range(60):
        t = rng.choices(["a", "b", "cd", "é", "the"], k=rng.randrange(0, 60))
        if rng.random() < 0.5:
            t.insert(rng.randrange(len(t) + 1), passage)
        texts.append(rng.choice([" ", "\n", "  ", "\t "]).join(t))
    texts += texts[:20] + ["w " * 40]
    for n, size in ((5, 300), (6, 1 << 20), (1, 200)):
        _, got = run(spark, texts, n, home_bytes=size)
        assert [(got[i].n_words, got[i].n_removed, got[i].kept_text) for i in range(len(texts))] == brute(texts, n)


def test_spans_are_maximal(spark):
    _, got = run(spark, ["x a b c d e y", "a b c d e z"], 3)
    assert [tuple(s) for s in got[0].removed_spans] == [(1, 6)] and got[0].kept_text == "x y"
    assert [tuple(s) for s in got[1].removed_spans] == [(0, 5)]


def test_empty_table_and_repeated_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in substring_dedup(df, min_words=3).collect()) == [(False, 0), (True, 3), (True, 3)]


def test_hot_rows_many_buckets_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 50)  # thousands of buckets, most of a home's rows hold one hash
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choices([f"w{i}" for i in range(60)], k=n))
    once, long = text(30), text(40_000)
    texts = [text(30) for _ in range(50)] + [long] + [once] * 40
    rows = [(min(i, 51), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (200_000, 0):
        monkeypatch.setattr(substring, "BROADCAST_KINDS", most)
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, min_words=6, home_bytes=20_000).collect())
        assert got == sorted((i, *x) for (i, _), x in zip(rows, brute(texts, 6)))

import random
import re
from collections import Counter

from laneprice.llm import quality_rules
from laneprice.llm.quality_rules import fit_quality, score_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_statistics_match_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", "\n\n", "a", "é|é\n\r\né|é", "x\n x\nx\n"]
    for _ in range(80):
        parts = rng.choices(["a", "b", "é#", "<x>", "\n", "\n", " line one two three four five six seven eight \n", "日本"], k=rng.randrange(60))
        texts.append(rng.choice(["", " "]).join(parts))
    df = spark.createDataFrame([(i, t, True, -1) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in score_quality(df, fit_quality(df, labels)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) == (not r.kept)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = "pmod(xxhash64(doc_id, 5), 2)"
    model = fit_quality(docs, labels.where(f"{fold} = 0"))
    held = docs.join(labels.where(f"{fold} = 1").withColumnRenamed("quality", "good"), "doc_id")
    rows = score_quality(held, model).where("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.good], [not r.kept for r in rows if not r.good]
    assert sum(good) >= 0.97 * len(good) and sum(bad) >= 0.7 * len(bad)


def test_empty_and_one_class(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert score_quality(df, fit_quality(df, labels)).collect() == []
    df = spark.createDataFrame([(1, "word " + " ".join(map(str, range(40))))], df.schema)
    assert score_quality(df, fit_quality(df, labels)).first().kept


def test_the_sample_is_bounded_where_ids_repeat(spark):
    rows = [(i % 20, f"word{i % 20} " * 30) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 3, "doc_id long, quality int")
    sampled = quality_rules.sampled(df, labels, "doc_id", "text", "quality", 10).collect()
    assert len(sampled) == len({r.id for r in sampled}) == 10


def test_any_column_names_and_a_long_text(spark):
    long = "many words of one long text " * 60_000
    df = spark.createDataFrame([(1, long, 7, True), (2, long, 8, False)], "doc_id long, text string, scored int, quality boolean")
    got = score_quality(df, fit_quality(df, spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert [(r.doc_id, r.text == long, r.scored, r.n_words, r.kept) for r in sorted(got)] == [(1, True, 7, 360_000, False), (2, True, 8, 360_000, False)]

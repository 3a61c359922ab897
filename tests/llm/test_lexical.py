import math
import random
import re
from collections import Counter

from laneprice.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, item_id string, score long, terms string", "item_id long, text string, doc_id long"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df, out = Counter(t for _, b in bags for t in b), []
    for item, text in items:
        scored = []
        for d, bag in bags:
            if not bag:
                continue
            m = 25 + 75 * sum(bag.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, k=10):
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], DOCS)
    found = lexical.ranked_search(df, spark.createDataFrame([(*i, 5) for i in items], ITEMS), k=k)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, k)


def cases():
    r = random.Random(3)
    words = ["Scale", "scale", "truck", "weigh-station", "naïve", "ß", "日本", "a", "b", "c", "x_y", "9", "lane price"]
    text = lambda n: " ".join(r.choices(words, k=n))
    docs = [(i, text(r.randrange(1, 30))) for i in range(120)]
    docs += [(500 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1]), (None, docs[7][1]), (None, text(4)), (900, None), (901, ""), (902, "-- !"), (903, text(30_000))]
    items = [(i, text(r.randrange(1, 9))) for i in range(12)] + [(3, "truck truck scale"), (20, None), (21, "unheard"), (22, ""), (None, "naïve b"), (23, "a"), (23, "a")]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = cases()
    for k in (1, 10):
        check(spark, docs, items, k)
    for name, size in (("ITEM_ENTRIES", 9), ("CLASS_PART", 5), ("SCORES", 30)):
        monkeypatch.setattr(lexical, name, size)
    check(spark, docs, items)


def test_large_vocabularies_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_VOCABULARY", 0)
    check(spark, *cases(), k=4)


def test_copies_are_one_class(spark):
    docs = [(i, "truck scale") for i in range(50)] + [(99, "scale truck"), (100, "truck truck scale")]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], DOCS)
    found = lexical.ranked_search(df, spark.createDataFrame([(1, "truck", 5)], ITEMS), k=3)
    assert [tuple(r)[1:3] for r in found.orderBy("rank").collect()] == [(1, 100), (2, 0), (3, 1)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "truck", "x", 1, "y")], DOCS)
    assert lexical.ranked_search(docs, items).collect() == lexical.ranked_search(some, items).collect() == []
    assert lexical.ranked_search(docs, spark.createDataFrame([(1, "truck", 5)], ITEMS)).collect() == []

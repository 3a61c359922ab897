import random
import re

import corpus_pipeline
from laneprice.llm import near_dedup
from laneprice.llm.components import connected_components
from laneprice.llm.near_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[j]:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "One", "É x", "é x"]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(20, 80))
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in copy))
    texts += texts[7:30]
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in enumerate(texts)], "doc_id long, text string, node int, component_id string")
    for k in (2, 5):
        got = {r.doc_id: r for r in near_duplicates(df, shingle=k).collect()}
        assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == brute(texts, k, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df, shingle=2).collect()), key=str)
    assert got == [(7, 2, 7, True), (7, 2, 7, True), (None, 0, None, True), (None, 2, 7, False)]
    assert near_duplicates(spark.createDataFrame([], df.schema)).collect() == []


def test_components_of_a_chain(spark):
    links = [(i * 7919 % 211, (i + 1) * 7919 % 211) for i in range(200)] + [(500, 501), (3, 3), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    chain = {i * 7919 % 211 for i in range(201)}
    assert {got[n] for n in chain} == {min(chain)} and got[501] == 500 and len(got) == len(chain) + 2


def test_stage_decides_per_row(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(5, a), (5, b), (3, b), (9, c), (9, c), (None, b + " more"), (None, "x y z"), (None, "x y z"), (6, ""), (6, ""), (7, ""), (6, None), (None, None)]
    df = spark.createDataFrame([(*r, n % 2) for n, r in enumerate(rows)], "doc_id long, text string, text_hash int")
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    want = [(5, a), (3, b), (9, c), (None, "x y z"), (6, ""), (7, ""), (6, None), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").collect() == []


def test_colliding_nodes_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE_BITS", 3)  # most sets share a node's number
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(90)], k=25)) for _ in range(40)]
    texts += [texts[0]] * 30 + [texts[1] + " more", " ".join(f"long{i % 5000}" for i in range(150_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 300 + [(None, texts[2])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(texts, 2, 80)
    got = near_dedup.near_duplicates(df, shingle=2).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id if r.doc_id is not None else 2]


def test_texts_on_one_template_do_not_meet(spark):
    rng = random.Random(5)
    template = [f"t{i}" for i in range(120)]
    met = {}
    for n in (60, 120):
        # 0.7 to 0.79 alike: no links, but they share buckets.
        texts = [" ".join(template + [f"own{i} {j}x{i}" for j in range(9)]) for i in range(n)]
        texts += [" ".join(template + rng.choices([f"w{i}" for i in range(30)], k=20)) for _ in range(12)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=2).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 2, 80)
        nodes = spark.createDataFrame([(i, i) for i in range(n)], "node long, component long")
        met[n] = near_dedup._rarest(nodes, spark.createDataFrame(list(enumerate(texts[:n])), "node long, text string"), 2, 80).count()
    assert met == {60: 0, 120: 0}  # what is rare in each is its own

"""Every stage of the pipeline, and all of them, against plain versions on small documents."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from laneprice.llm.shared import table

from .test_near_dedup import brute
from .test_quality_rules import brute as statistics

P = pytest.importorskip("public_tokenizers")
KIND = "doc_id long, text string, lang string, source string, n_chars long, copy string, text_hash string, mix_key long, `a.b` string, tags map<string,int>, `more` array<int>, row string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "copy", "text_hash", "mix_key", "a.b", "tags", "more", "row"]
SECRET = "password = hunter22secret"


def rows():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    out = [(i, text(rng.randrange(30, 90)), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(40)]
    out += [(100 + i, out[i][1] + " end", "de", "b") for i in range(5)] + [(3, out[7][1], "en", "a"), (3, text(50), "en", "b")]
    out += [(None, text(40), "en", "c"), (None, out[9][1], "en", "c"), (200, text(40) + f" {SECRET} " + text(9), "fr", "c"), (201, text(2500), "en", "a")]
    out += [(300, None, "en", "a"), (301, "", None, "b"), (302, "too short", "en", "b"), (303, "one two three four five six seven eight " * 9, "en", "a")]
    out += out[:6]
    return [(*r, None if r[1] is None else len(r[1]), "mine", "h", 7, "dotted", {"k": len(r[1] or "")}, [1, None], "r") for r in out]


def frozen(r):
    return tuple(tuple(sorted(v.items())) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for v in r)


def plain(df):
    return [frozen(r) for r in df.collect()]


def copies(docs):
    mass = Counter()
    for r in docs:
        mass[r[3]] += len(r[1] or "") + 1
    out = Counter()
    for r in docs:
        name = str(r[0]) if r[0] is not None else "text " + hashlib.md5((r[1] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"copies 17|{name}".encode()).hexdigest()[:13], 16) / 2**52
        rate, n, below = sum(mass.values()) / (len(mass) * mass[r[3]]), 0, math.exp(-sum(mass.values()) / (len(mass) * mass[r[3]]))
        p = below
        while below <= u:
            n += 1
            p *= rate / n
            below += p
        out[r] += n
    return +out


def test_stages_and_run(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame(rows(), KIND).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, got = table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        got[name] = plain(docs)
        assert name == "packing" or docs.columns == COLUMNS

    kept = [frozen(r) for r in rows() if (s := statistics(r[1]))[0] >= 20 and 100 * s[4] <= 30 * s[0]]
    assert Counter(got["quality"]) == Counter(kept) and {r[0] for r in rows()} - {r[0] for r in kept} == {300, 301, 302, 303}

    groups = defaultdict(list)
    for r, (_, root) in zip(kept, brute([r[1] for r in kept], 5, 80)):
        groups[root].append(r)
    assert all(sum(r in g for r in got["near_dedup"]) == 1 for g in groups.values()) and len(got["near_dedup"]) == len(groups)
    for g in groups.values():
        least = min(g, key=lambda r: (r[0] is None, r[0] or 0))
        assert [r[0] for r in got["near_dedup"] if r in g] == [least[0]]

    clean = {(r[0], r[2], r[3], r[5], r[6]): [] for r in got["secrets"]}
    for r in got["secrets"]:
        assert "hunter22secret" not in r[1] and r[4] == len(r[1])
        clean[r[0], r[2], r[3], r[5], r[6]].append(r[1])
    for r in got["near_dedup"]:
        mine = clean[r[0], r[2], r[3], r[5], r[6]]
        assert r[1] in mine if SECRET not in r[1] else any(t.startswith(r[1][:80]) for t in mine)
    assert len(got["secrets"]) == len(got["near_dedup"])
    assert Counter(r[5:] for r in got["secrets"]) == Counter(r[5:] for r in got["near_dedup"])

    assert Counter(got["mixing"]) == copies(got["secrets"])

    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for r in got["mixing"]:
        n = len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1
        want.update((r[0], a // 2048, a, min(2048, n - a)) for a in range(0, n, 2048))
    assert Counter(r[:4] for r in got["packing"]) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(got["packing"])


def test_stages_take_nothing(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], KIND).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []

import hashlib
import math
from collections import Counter

import pytest

from laneprice.llm import mixing


def brute(rows, weights, seed):
    mass = Counter()
    for _, s, t in rows:
        mass[s] += len(t or "") + 1
    w = {s: (1.0 if weights is None else weights.get(s, 0.0)) for s in mass}
    out = Counter()
    for i, s, t in rows:
        rate = w[s] * sum(mass.values()) / (sum(w.values()) * mass[s]) if sum(w.values()) else 0.0
        name = str(i) if i is not None else "text " + hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"copies {seed}|{name}".encode()).hexdigest()[:13], 16) / 2**52
        k, c = 0, math.exp(-rate)  # P(X <= k)
        while rate and c <= u:
            k += 1
            c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out[(i, s, t)] += k
    return +out


def test_counts_are_inverted_poisson(spark, monkeypatch):
    rows = [(i, "abc"[i % 7 % 3], "x" * (i % 50)) for i in range(400)] + [(500, None, "null source"), (501, "a", None), (None, "b", "no id"), (None, "b", None), (7, "b", "again"), (7, "b", "again")]
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], "doc_id long, source string, text string, copy int, owner string")
    for weights in (None, {"a": 3, "b": 1, None: 0.5}, {}):
        got = mixing.mix_sources(df, weights, seed=5)
        found = got.collect()
        assert Counter((r.doc_id, r.source, r.text) for r in found) == brute(rows, weights, 5)
        assert [r.mix_key for r in found] == sorted(r.mix_key for r in found)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter((r.doc_id, r.source, r.text) for r in mixing.mix_sources(df, None, seed=5).collect()) == brute(rows, None, 5)


def test_large_rates_and_empty(spark):
    df = spark.createDataFrame([(i, "big", "x" * 2000) for i in range(200)] + [(900, "small", "y" * 100)], "doc_id long, source string, text string")
    n = mixing.mix_sources(df, {"small": 1}).count()
    assert abs(n - 200 * 2001 / 101) < 400
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_any_column_names_and_refused_weights(spark):
    names = ["doc_id", "source", "text", "of_source", "low", "cdf", "name", "own", "salt", "part", "times", "block", "_n", "_u", "_name", "rate", "k"]
    rows = [(i, "ab"[i % 2], "x" * i, *range(100 * i, 100 * i + len(names) - 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} long" for n in names[3:]))
    for most in (10_000, 0):  # sources that may be broadcast
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(mixing, "BROADCAST_SOURCES", most)
            got = mixing.mix_sources(df)
            assert got.columns == [*names, "copy", "mix_key"]
            assert Counter((r.doc_id, r.source, r.text) for r in got.collect()) == brute([(r[0], r[1], r[2]) for r in rows], None, 17)
            kept = {tuple(r)[: len(names)] for r in got.collect()}
            assert kept and kept <= set(rows)
    for bad in ({"a": -1.0}, {"a": float("nan")}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            mixing.mix_sources(df, bad)
    assert mixing.mix_sources(df, {"a": 0.0}).collect() == []


def test_distribution_of_a_large_rate(spark):
    rates = spark.createDataFrame([("a", 250.0), ("b", 40_000.0), ("c", 3.5), ("d", 1e8)], "source string, rate double")
    for r in mixing.poisson_tables(rates).collect():
        assert len(r.cdf) <= 17 * math.sqrt(r.rate) + 45 and abs(r.cdf[-1] - 1) < 1e-7
        for k in range(0, len(r.cdf), max(1, len(r.cdf) // 7)):
            want = sum(math.exp(i * math.log(r.rate) - r.rate - math.lgamma(i + 1)) for i in range(r.low, r.low + k + 1)) if r.rate < 1e5 else None
            assert want is None or abs(want - r.cdf[k]) < 1e-9
    df = spark.createDataFrame([(i, "big", "x" * 20_000) for i in range(20)] + [(900, "small", "")], "doc_id long, source string, text string")
    n = mixing.mix_sources(df).where("source = 'small'").count()  # a rate of 200,010 in blocks
    assert abs(n - 20 * 20_001 / 2) < 3000

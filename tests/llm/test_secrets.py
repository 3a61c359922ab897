import re
from collections import defaultdict

from pyspark.sql import functions as F

from laneprice.llm import secrets
from laneprice.llm.secrets import MASK, find_secrets, listed, redact_secrets

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
OWNED = re.compile(r"[A-Za-z0-9+/_=-]+")


def brute(rows, most):
    owners, found = defaultdict(set), []
    for _, source, text in rows:
        spans = [(m.start(), i, m.end(), k, m[g]) for i, (k, (p, g, n)) in enumerate(BASE.items()) for m in p.finditer(text or "") if len(m[g]) >= n]
        more = [(m.start(), 3, m.end(), "owned", m[0]) for m in OWNED.finditer(text or "") if len(m[0]) >= 20 and all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
        for s in spans + more:
            owners[s[4]].add(source)
        found.append((spans, more))
    out = []
    for spans, more in found:
        own = [s for s in more if len(owners[s[4]]) <= most and not any(b[0] < s[2] and s[0] < b[2] for b in spans)]
        out.append(",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in sorted(spans + own)))
    return out


TEXTS = [
    None, "", "é\U0001f600 password=abc123 x", "PassWord' :  \"abcdef\" token=ab secret=token=abcdefgh", "password=token:abcdefgh", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "AKIAAKIA" + "9" * 12,
    "f" * 23 + " " + "0f" * 12 + "g", "api_key=" + "0a" * 14, "ABCdef0123456789ABCdef/+", "wide ABCdef0123456789ABCdeQ", "apikey=ABCdef0123456789ABCdef/+", "ſecret=abcdefgh toKen=abcdefgh",
    "a" * 5000 + " passwd=" + "z" * 3000,
]


def test_matches_brute_force(spark):
    rows = [(i, "src0", t) for i, t in enumerate(TEXTS)] + [(100 + i, f"src{i}", TEXTS[10]) for i in range(4)] + [(200, None, TEXTS[8]), (200, None, TEXTS[8])]
    df = spark.createDataFrame([(*r, "live") for r in rows], "doc_id long, source string, text string, kind string")
    got = find_secrets(df, repository=df["source"], owner=df["source"]).withColumn("spans", listed(F.col("secrets"))).collect()
    assert sorted((r.doc_id, r.spans) for r in got) == sorted((i, s) for (i, _, _), s in zip(rows, brute(rows, 2)))
    assert find_secrets(df.limit(0)).collect() == []


def test_redaction(spark):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(TEXTS)] + [(None, "s", TEXTS[2])], "doc_id long, source string, text string")
    clean = redact_secrets(df, owner=df["source"])
    got = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == df.columns and len(got) == len(TEXTS) + 1
    assert got[0] is None and got[1] == "" and got[2] == got[None] == f"é\U0001f600 {MASK} x" and got[8] == MASK
    assert got[7] == "f" * 23 + f" {MASK}g" and got[13] == MASK + " " + MASK


def test_a_common_secret_and_any_column_names(spark, monkeypatch):
    extra = "found_id found_hash own_hash spans _id _hash _secrets _text_hash secrets row salt hash".split()
    rows = [(i % 400, f"s{i % 3}", "key " + TEXTS[9] if i % 2 else TEXTS[2], *[i] * len(extra)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} int" for n in extra))
    for most in (200_000, 0):
        monkeypatch.setattr(secrets, "BROADCAST_VALUES", most)
        got = redact_secrets(df, owner=df["source"]).collect()
        assert sorted((tuple(r)[:2] + tuple(r)[3:]) for r in got) == sorted(r[:2] + r[3:] for r in rows)
        # three owners have the token, so it isn't live and stays; the assignment goes
        assert {r.text for r in got} == {"key " + TEXTS[9], f"é\U0001f600 {MASK} x"}

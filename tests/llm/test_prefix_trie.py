import hashlib
import random
import zlib

from laneprice.llm import prefix_trie as trie

KIND = "conv_id long, turn int, role string, text string, depth string, seq string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))

    def key(t):
        return t[0], t[1], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()

    own = {c: [t[2:] for t in sorted(ts, key=key)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(x) == len(n) + 1 and x[: len(n)] == n for x in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], KIND)
    got = trie.prefix_trie(*trie.shared_heads(trie.numbered_turns(df)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "LISTED_CHARS", 9)
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None, "é" * 5])) for c in range(40) for t in range(r.randrange(1, 13))]
    rows += [(100 + c, t, "user", "same") for c in range(30) for t in range(3)]  # copies
    rows += [(-7, 0, "user", "x"), (-5, 0, "user", "x"), (None, 0, "user", "x"), (203, None, "user", "b"), (203, None, "user", "a"), (203, 1, "user", "z"), (203, 1, "user", "z")]
    rows += [(300, t, "user", str(t % 3)) for t in range(70)] + [(302, t, "user", str(t % 3)) for t in range(64)]  # long ones
    r.shuffle(rows)
    check(spark, rows)


def test_one_and_none(spark):
    check(spark, [(5, 0, "user", "x")])
    check(spark, [(c, 0, "user", "x") for c in range(6)])  # some are left without turns
    check(spark, [])


def test_sequences_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, t, "user", f"text {t}") for t in range(400)] + [(2, 0, "user", "b")]
        got = trie.numbered_turns(spark.createDataFrame([(*r, "x", "y") for r in rows], KIND).repartition(7))
        assert sorted(got.where("seq = 1").select("pos").collect()) == [(i,) for i in range(400)]
        assert got.join(spark.createDataFrame([(t, len(f"text {t}")) for t in range(400)], "pos long, n long"), "pos").where("seq = 1 AND bytes <> n").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

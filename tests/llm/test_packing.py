import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from laneprice.llm.packing import best_two_fit, deal, pack, pack_documents, tokenize

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_best_two_fit_packs_tightly():
    rng = random.Random(2)
    for capacity, lengths in ((10, [6, 5, 5, 3, 1]), (2048, [rng.randrange(1, 2049) for _ in range(3000)]), (100, [100, 1, 99, 50, 50]), (7, [])):
        bins, offsets = best_two_fit(lengths, capacity)
        held = defaultdict(list)
        for n, b, o in zip(lengths, bins, offsets):
            held[b].append((o, n))
        for items in held.values():
            items.sort()
            assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))] and sum(n for _, n in items) <= capacity
        assert len(held) <= 1.06 * -(-sum(lengths) // capacity) + 1


def test_two_replace_the_smallest():
    bins, _ = best_two_fit([6, 3, 2, 2], 10)  # 6 + 3 leaves 1; 2 + 2 fill the 4 that are free without the 3
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_ids_equal_those_of_whole_texts(spark):
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(4)
    texts = [None, "", " \n\t", "Hello,world it's 12's <|endoftext|>x \x0b\x0c\r\n e ́́ ΣΑΣ ΑΣ Σ \x1c a\x85b 日本"]
    texts += ["".join(rng.choices("aé'sß .\n1#́ <|endoftext|>'", k=rng.randrange(80))) for _ in range(60)] + ["ab " * 3000, "x" * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    ids = defaultdict(list)
    for r in tokenize(df, PATH).orderBy("doc_id", "piece").collect():
        assert r.start == len(ids[r.doc_id]) and r.length == len(r.ids) // 4 <= 2048
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    for i, t in enumerate(texts):
        assert ids[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], t
    rows = pack_documents(df, PATH).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for items in held.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))]
    assert pack_documents(df.limit(0), PATH).collect() == []


def test_copies_of_one_piece_are_spread(spark):
    rows = [(1, 700)] * 1003 + [(2, 30)] * 3 + [(None, 9)] * 2 + [(i, 100) for i in range(3, 100)]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    sizes = defaultdict(int)
    for r in deal(df, 10).where("doc_id = 1").collect():
        sizes[r.pack_group] += r.pack_times
    assert sorted(sizes.values()) == [100] * 7 + [101] * 3
    packed = pack(df, 10).collect()
    assert sorted(((r.doc_id, r.length) for r in packed), key=str) == sorted(rows, key=str)
    held = defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    for items in held.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))] and sum(n for _, n in items) <= 2048
    assert len({s >> 32 for s in held}) == 10


def test_any_column_names_pass_through(spark):
    names = "pack_group pack_times n first j piece".split()
    rows = [(i % 3, 100 + i % 5, *[i % 2] * len(names)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, length long, " + ", ".join(f"{n} int" for n in names))
    got = pack(df, 4)
    assert got.columns == [*df.columns, "sequence_id", "offset"]
    assert sorted(tuple(r)[:-2] for r in got.collect()) == sorted(rows)


def literal(lengths, capacity):
    """Greedy fill, then two unpacked ones for the smallest of the bin while that fills the gap better; lengths of every bin."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        mine = []
        while fits := [n for n in left if n <= capacity - sum(mine)]:
            mine.append(fits[0])
            left.remove(fits[0])
        while capacity > sum(mine):
            small, room = min(mine), capacity - sum(mine) + min(mine)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= room]
            if not pairs:
                break
            _, a, b = max(pairs)
            mine.remove(small)
            mine += [a, b]
            left.remove(a), left.remove(b)
            left = sorted([*left, small], reverse=True)
        bins.append(sorted(mine))
    return sorted(bins)


def test_bins_are_those_of_the_literal_rule():
    rng = random.Random(9)
    for _ in range(150):
        capacity = rng.choice([7, 10, 40, 100])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 25))]
        held = defaultdict(list)
        for n, b in zip(lengths, best_two_fit(lengths, capacity)[0]):
            held[b].append(n)
        assert sorted(map(sorted, held.values())) == literal(lengths, capacity)

import random

from laneprice.llm import warc


def test_round_trip(spark):
    rng = random.Random(6)
    pages = [(i, f"http://x/{i}", rng.choice(["é", "WARC/1.1\r\n", "\r\n\r\n", "a", "0\r\n"]) * rng.randrange(0, 3000)) for i in range(60)]
    pages += [(100 + i, "http://same", "same" * 9000) for i in range(5)] + [(200, None, None), (201, "a\nb", ""), (None, "n", "only null"), (None, "n", "same" * 9000), (100, "http://same", "same" * 9000)]
    rng.shuffle(pages)
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string")
    for least in (0, 30):
        rows = warc.read_archives(spark, warc.write_archives(df, least_revisit_bytes=least, segment_bytes=700)).collect()
        assert len(rows) == len(pages) and all(r.error is None for r in rows)
        first = {}
        for i, _, h in pages:
            first[h or ""] = min(first.get(h or "", (True, 0)), (i is None, i or 0))
        want, got = [], []
        for i, _, h in pages:
            raw, at = (h or "").encode(), first[h or ""]
            again = len(raw) >= least and at != (i is None, i or 0)
            want.append((str(i), len(raw), warc.digest(raw), "revisit" if again else "response", at[1] if again else None, None if again else raw))
        got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).collect() == []


def test_damage_is_told(spark, tmp_path):
    records = warc.page_records(3, 9, "u", b"x" * 5000, None, "2024-01-01T00:00:00Z", 1000)
    for name, kept in (("gap", records[:2] + records[3:]), ("short", records[:-1]), ("whole", records[::-1])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in kept))
        row = warc.read_archives(spark, str(tmp_path / name)).first()
        assert (row.error is None) == (name == "whole") and (row.payload is None) == (name != "whole") and row.page_id == 3


def test_chunked_framing():
    for n in (0, 1, 4096, 4097, 10000):
        assert warc.dechunked(warc.chunked(b"y" * n)) == b"y" * n
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"

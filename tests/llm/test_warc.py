import hashlib
import io
import random

from wordloom.llm import common, warc


def table():
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdé<>") for _ in range(n))
    hot, small = text(1500), text(100)
    pages = [(k, f"http://x/{k}", text(r.randrange(0, 4000))) for k in range(40)]
    pages += [(100 + k, "http://hot", hot) for k in range(30)] + [(200 + k, None, small) for k in range(5)]
    pages += [(300, "u\r\nv", None), (301, "", ""), (302, "z", "\x1f\x8b\x08" * 50 + "é" * 600), (-5, "n", "x" * 1000), (-6, "n", "x" * 1000), (7, "again", pages[7][2])]
    return pages


def want(pages):
    raw = [(i, (h or "").encode()) for i, _, h in pages]
    out = []
    for i, b in raw:
        top = max(j for j, c in raw if c == b) if len(b) >= 1000 else i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if top == i else "revisit", None if top == i else top))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = table()
    spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, digest string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(x) for x in warc.op4_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == want(pages)
    archives = warc.write(common.table(spark, str(tmp_path), "pages"), f"file://{tmp_path}/w")
    n = warc.read(archives).count()
    assert n == len(pages)
    assert [warc.read(archives, k).count() for k in (700, 4096)] == [n, n]


def test_ranges_own_what_starts_inside():
    r = random.Random(2)
    body = [bytes(r.randrange(256) for _ in range(r.randrange(0, 300))) + warc.MAGIC * 3 for _ in range(30)]
    data, starts = b"", []
    for k, b in enumerate(body):
        starts.append(len(data))
        data += warc.member(warc.record("response", k, "u", b, hashlib.sha1(b).hexdigest(), None))
        if k % 7 == 0:
            data += b"junk" + warc.MAGIC + b"no member"
    for step in (1, 13, 64, 1000, len(data)):
        got = [at for s in range(0, len(data), step) for at, _, _ in warc.records(io.BytesIO(data), s, s + step, len(data))]
        assert got == starts, step


def test_damaged_records_are_reported():
    make = lambda k, n: warc.member(warc.record("response", k, "u", random.Random(k).randbytes(n), "00" * 20, None))
    parts = [make(0, 400), make(1, 200_000), make(2, 400)]
    data = bytearray(b"".join(parts))
    for k in range(100):
        data[len(parts[0]) + 150_000 + k] ^= 0xFF
    got = [(at, f["warc-type"]) for at, f, _ in warc.records(io.BytesIO(bytes(data)), 0, len(data), len(data))]
    assert got == [(0, "response"), (len(parts[0]), "damaged"), (len(parts[0]) + len(parts[1]), "response")]
    cut = b"".join(parts)[:-30]
    assert [f["warc-type"] for _, f, _ in warc.records(io.BytesIO(cut), 0, len(cut), len(cut))][:2] == ["response", "response"]


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages, f"file://{tmp_path}/w")).count() == 0

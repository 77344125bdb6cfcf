import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wordloom.functions import headers, mail, markup, slices
from wordloom.sources import readers

PAGE = '<html><title>T</title><script>if (x<y) {}</script>A&amp;B&lt;c<br>d<a href="http://x.com/a?b=c%20d" onclick="go()">l</a><!-- note --><img alt="pic"></html>'


@pytest.mark.parametrize("show, has, lacks", [((), ["T", "A&B(c\nd", "l"], ["note", "if", "x.com", "pic"]), (("links",), ["x.com a b c d"], ["pic"]), (("comments", "scripts", "alt"), ["note", "if (x<y)", "go()", "pic"], ["x.com"])])
def test_visible_text(show, has, lacks):
    got = markup.clean(PAGE, frozenset(show))
    assert all(x in got for x in has) and not any(x in got for x in lacks)


def test_markup_cases():
    assert markup.clean(None) == "" and markup.clean("plain < text") == "plain < text"
    assert markup.clean("a<script>never closed") == "a"
    assert markup.clean("head<b>x</b>", smart=True) == "x"
    assert markup.decode_entities("&#65;&#x42;&nbsp;&eacutex &bogus;") == "AB éx &bogus;"


MAIL = """From x
From: =?UTF-8?B?SsO2cmc=?= <j@x.org>
Subject: =?US-ASCII?Q?Hello_w=6frld?=
X-Spam: yes
Received: from a by b; Mon, 5 Jan 2004 10:00:00 GMT
Content-Type: multipart/mixed; boundary="q"

pre
--q
Content-Type: text/plain
Content-Transfer-Encoding: base64

aGVsbG8g
d29ybGQ=
--q
Content-Type: text/html

<b>hi</b> &amp; ho<script>no</script>
--q
Content-Type: image/png

zzzz
--q--
"""


def test_mail_lines():
    got = list(mail.message_lines(MAIL))
    text = [x for x, _ in got]
    assert "from: Jörg <j@x.org>" in text and "hello world" in text and "hi & ho" in text and "pre" in text
    assert not any("zzzz" in x or "yes" in x or "Received" in x for x in text)
    assert "subject: Hello w=6frld" in text  # escapes in lower case stay
    more = [x for x, _ in mail.message_lines(MAIL, frozenset({"xheaders", "theaders"}))]
    assert "x-spam: yes" in more and "received: from a by b" in more
    assert list(mail.message_lines(None)) == [] and [x for x, _ in mail.message_lines("no header here")] == ["no header here"]


def test_armour():
    text = "Subject: x\n\na\n-----BEGIN PGP MESSAGE-----\nAAAABBBBCCCCDDDDEEEEFFFF\n-----END PGP MESSAGE-----\nbegin 644 f\nM12345\nend\nb"
    assert [x for x, c in mail.message_lines(text) if c == 1] == ["a", "b"]


def test_mailboxes(spark, tmp_path):
    (tmp_path / "box").write_text("From a\nSubject: 1\n\nx\n\nFrom b\nSubject: 2\n\n>From here on\n")
    got = readers.mailboxes(spark, f"file://{tmp_path}/box").orderBy("number").collect()
    assert [r.raw.split("\n")[1] for r in got] == ["Subject: 1", "Subject: 2"]
    assert readers.directory(spark, f"file://{tmp_path}").first().text.startswith("From a")
    (tmp_path / "scores").write_text("# scores a 2.50 * 4.0 b 1.00 * 4.0\n")
    assert [(r.model, r.score) for r in readers.score_lines(spark, f"file://{tmp_path}/scores").collect()] == [("a", -10.0), ("b", -4.0)]


@pytest.mark.parametrize(
    "name, value, keeps, breaks",
    [
        ("From", "Bob <bob@x.org>, a@b.c", ["rfc822", "rfc2822"], []),
        ("From", "bad bad@", [], ["rfc822", "rfc2822", "rfc2822-lax"]),
        ("To", "<@hop.net:a@b.c>", ["rfc822", "rfc2822-obs"], ["rfc2822"]),
        ("Date", "Mon, 5 Jan 2004 10:00:00 EST", ["rfc822", "rfc2822-obs"], ["rfc2822"]),
        ("Return-Path", "<a@b.c>", ["rfc821", "rfc2821", "rfc2822"], []),
        ("X-Other", "anything", [], ["rfc822"]),
    ],
)
def test_conformance(name, value, keeps, breaks):
    got = headers.conforms(name, value)
    assert set(keeps) <= set(got) and not set(breaks) & set(got)


def test_header_values():
    assert headers.epoch("Mon, 5 Jan 2004 10:00:00 +0100") == 1073293200
    assert headers.epoch("nonsense") is None and headers.epoch("5 Jan 2090 10:00:00") is None
    assert headers.addresses('"A, B" <a@b.c>, (note) d@e.f') == ["a@b.c", "d@e.f"]
    assert [h["tag"] for h in headers.analyse("From: a@b\n folded\nTo: c@d\n\nBody: no")] == ["from", "to"]


def test_catalog_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    q, o = entry.queries(), entry.oracle_sql()
    for name in ("tok_alpha", "ngram2_counts", "model_fit", "posterior", "line_filter", "chernoff_point", "risk_decision", "cross_validation", "page_links"):
        df = q[name](spark, sf)
        cols = sorted(df.columns)
        r = con.execute(o[name])
        at = [[d[0] for d in r.description].index(c) for c in cols]
        assert sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr) == sorted((tuple(x[c] for c in cols) for x in df.collect()), key=repr), name


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "truth", "best", "score"]
    assert df.where(F.col("truth") == F.col("best")).count() > 0.9 * df.count()


def test_texts_are_taken_in_slices():
    texts = pa.array(["x" * 400, None, "", "y" * 700, "z" * 5000, "ab"])
    parts = [p.to_pylist() for p in slices.slices(texts, 1000)]
    assert sum(parts, []) == texts.to_pylist() and [len(p) for p in parts] == [3, 1, 1, 1]
    assert list(slices.slices(texts.slice(0, 0))) == []


def test_pages_take_little_memory_at_once(spark):
    """A batch of 200 pages of 100 KB is not held as Python strings and their results at one time."""
    texts = pa.array(["<p>" + "word " * 20_000] * 200)
    run = markup.clean_udf().func
    tracemalloc.start()
    n = sum(len(x) for x in run(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200 and peak < 10e6


@pytest.mark.parametrize("size", ["10000", "2"])
def test_slices_keep_rows_in_place(spark, size):
    rows = [(k, "<b>" + f"{k} " * (50_000 if k % 3 == 0 else 3)) for k in range(30)] + [(30, None), (31, "")]
    d = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {r.page_id: r.t for r in d.select("page_id", markup.clean_udf()("html").alias("t")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: markup.clean(t) for k, t in rows}

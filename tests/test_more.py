import math
import time

import pytest
from pyspark.sql import functions as F

from wordloom.functions import headers, mail, special
from wordloom.functions import text as tx
from wordloom.operators import decision, evaluate, fit, score
from wordloom.operators import features as ft
from wordloom.sources import models

TEXTS = [(1, "a", "red green blue red"), (2, "a", "green red red"), (3, "b", "one two three two"), (4, "b", "three one one blue"), (5, "b", "one")]


def counted(spark, rows=TEXTS, *by):
    d = spark.createDataFrame(rows, "doc_id long, model string, text string")
    return ft.counts(ft.token_rows(d), "model", *by)


@pytest.mark.parametrize(
    "name, value",
    [
        ("from", "a" * 100_000 + "\x01"),
        ("from", "a " * 50_000 + "\x01"),
        ("to", "a@b, " * 20_000 + "\x01"),
        ("to", "a.b" * 30_000 + "@"),
        ("from", "(" * 50_000 + ")" * 50_000 + "a@b"),
        ("received", "from a by b;" + "1 ;" * 30_000),
        ("received", "a b " * 30_000),
        ("date", " " * 100_000 + "x"),
        ("from", '"' * 100_001),
        ("return-path", "<a@" + "a-" * 50_000),
    ],
)
def test_long_headers_are_read_once(name, value):
    began = time.process_time()
    headers.conforms(name, value)
    headers.addresses(value)
    assert time.process_time() - began < 3


OBSOLETE = ["rfc822", "rfc2822-obs", "rfc2822-lax"]
ALL = ["rfc822", "rfc2822", "rfc2822-obs", "rfc2822-lax"]


@pytest.mark.parametrize(
    "name, value, want",
    [
        ("from", "Joe <a@b.c>", ALL),
        ("from", "J. Doe <a@b>", OBSOLETE[1:]),
        ("from", "a@b.c (one (two (three)))", ALL),
        ("from", "a@b.c (open", []),
        ("to", "Friends: a@b, c@d;", ALL),
        ("to", "Nobody:;", ALL),
        ("to", "a@b,, c@d", OBSOLETE),
        ("to", "<@x,@y:a@b>", OBSOLETE),
        ("to", '"a b" <"odd \\" one"@b>', ALL),
        ("date", "Mon, 5 Jan 2004 10:00:00 GMT", OBSOLETE),
        ("date", "5 Jan 2004 10:00 +0100", ALL),
        ("return-path", "<>", [*headers.GRAMMARS]),
        ("return-path", "<a-@b.c>", [*headers.GRAMMARS]),
        ("return-path", "<a@b-.c>", [x for x in headers.GRAMMARS if x not in ("rfc821", "rfc2821")]),
        ("subject", "any (thing", ALL),
        ("x-none", "a", []),
        ("from", "w" * 20_000 + "@b", ALL),
    ],
)
def test_conformance(name, value, want):
    assert sorted(headers.conforms(name, value)) == sorted(want)


def texts(raw, *opts):
    return [x for x, _ in mail.message_lines(raw, frozenset(opts))]


def test_lost_boundaries():
    raw = 'From: a\nContent-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/plain\n\nhello\n\n--broken\nX: y\nContent-Type: image/png\n\nzzzz\n--q--\n'
    assert "hello" in texts(raw) and "zzzz" not in texts(raw)
    assert "zzzz" in texts(raw, "plain")
    late = raw.replace("X: y\n", "X: y\n" * 6)
    assert "zzzz" in texts(late)
    none = "From: a\nContent-Type: text/plain\n\nhello\n\nContent-Type: application/zip\n\nPK-zzzz"
    assert texts(none) == ["from: a", "hello", "", ""] and "PK-zzzz" in texts(none, "atts")


@pytest.mark.parametrize("dashes, split", [(30, True), (70, True), (31, False), (29, False)])
def test_digests(dashes, split):
    raw = "Subject: all\n\nintro\n" + "-" * dashes + "\n\nDate: today\nSubject: one\n\nbody\n"
    assert ("subject: one" in texts(raw)) == split and ("Date: today" not in texts(raw)) == split and "body" in texts(raw)


def test_depth_and_options():
    deep = "Subject: in\n\ncore"
    for _ in range(2000):
        deep = "Content-Type: message/rfc822\n\n" + deep
    assert texts(deep)[-1] == "core"
    raw = "From: a\nDate: z\nDelivery-Date: z\nX-A: 1\n\n<b>x</b> y"
    assert texts(raw, "xheaders", "noplain") == ["from: a", "x-a: 1", "x y"]
    assert "<b>x</b> y" in texts(raw)


def test_classes_are_part_of_features(spark):
    d = spark.createDataFrame([("m", 1, "red red blue"), ("m", 2, "red"), ("m", 2, "green")], "model string, cls int, text string")
    f, m = fit.fit(fit.with_uniform(ft.counts(ft.token_rows(d), "model")), 1)
    assert {(r.cls, r.gram): r.cnt for r in f.collect()} == {(1, "red"): 2, (1, "blue"): 1, (2, "red"): 1, (2, "green"): 1}
    z = m.first().log_z
    mass = {c: sum(math.exp(r.dref) * math.expm1(r.lam) for r in f.collect() if r.cls == c) for c in range(16)}
    for r in fit.media_log_probabilities(f, m).collect():
        assert abs(r.log_p + math.log(1 / 16 + mass[r.cls]) - z) < 1e-9
    docs = spark.createDataFrame([(1, 1, "blue"), (2, 2, "blue")], "doc_id int, cls int, text string")
    got = {r.doc_id: r.n_hits for r in score.score(ft.counts(ft.token_rows(docs), "doc_id"), f, m).collect()}
    assert got == {1: 1, 2: 0}
    two = ft.counts(ft.gram_rows(d, 2), "model")
    g, _ = fit.fit(fit.with_uniform(two), 2)
    lam = {(r.cls, r.gram): r.lam for r in g.where("ord = 1").collect()}
    assert all(r.ltrms == lam[r.cls, r.gram.split(" ")[-1]] for r in g.where("ord = 2").collect())


@pytest.mark.parametrize("limit", [500_000, 0])
def test_preloaded_weights_need_fewer_rounds(spark, limit):
    c = fit.with_uniform(counted(spark))
    f, m = fit.fit(c, 1, 3, class_limit=limit)
    g, n = fit.fit(c, 1, 3, class_limit=limit, start=f)
    before, after = ({r.model: r for r in x.collect()} for x in (m, n))
    assert all(after[k].iterations < before[k].iterations and abs(after[k].log_z - before[k].log_z) < 0.2 for k in before)


def test_gamma_law(spark):
    c = counted(spark, TEXTS, "doc_id")
    f, m = fit.fit(fit.with_uniform(c.groupBy("model", "ord", "gram").agg(F.sum("cnt").alias("cnt"))), 1)
    z = {r.model: r.log_z for r in m.collect()}
    w = {(r.model, r.gram): r.lam + r.dref - z[r.model] if r.lam > 0 else 0.0 for r in f.collect()}
    got = {r.model: r for r in fit.gamma_law(c, f, m).collect()}
    for model in "ab":
        div = []
        for _, _, t in (x for x in TEXTS if x[1] == model):
            words = t.split()
            p = [words.count(x) / len(words) for x in set(words)]
            div.append(-(-sum(x * math.log(x) for x in p)) - sum(w[model, x] for x in words) / len(words))
        mu = sum(div) / len(div)
        s2 = sum((x - mu) ** 2 for x in div) / (len(div) - 1)
        r = got[model]
        assert abs(r.mu - mu) < 1e-9 and abs(r.s2 - s2) < 1e-9 and abs(r.alpha - mu**2 / s2) < 1e-6 and abs(r.beta - s2 / mu) < 1e-9
    one = fit.gamma_law(c.where("doc_id = 1"), f, m).first()
    assert (one.s2, one.alpha, one.beta) == (0, 0, 0)
    s = score.score(ft.counts(ft.token_rows(spark.createDataFrame([(x[0], x[2]) for x in TEXTS], "doc_id long, text string")), "doc_id"), f, m)
    law = spark.createDataFrame([(r.model, r.alpha, r.beta) for r in got.values()], "model string, alpha double, beta double")
    for r in evaluate.rank_scores(s, law=law).collect():
        assert r.s3 == special.gamma_p(r.div, got[r.model].alpha, got[r.model].beta) // 10


RISK = """
categories { x, y, z }
prior { 2, 1, 1 }
loss_matrix {
  "" x [ 0, 3, 1 ]
  "" y [ 2, 0, complexity ]
  "" z [ 1, 5, 0 ]
}
"""


def test_recursive_decisions_against_loops(spark):
    spec = decision.parse(RISK)
    docs = [(k, [-(k * 7 % 5) / 2, -(k * 3 % 4) / 1.5, -float(k % 3)]) for k in range(20)]
    rows = [(k, c, s[i], 4.0) for k, s in docs for i, c in enumerate("xyz")]
    d = spark.createDataFrame(rows, "doc_id long, model string, score double, complexity double")
    loss = [[0, 3, 1], [2, 0, 4], [1, 5, 0]]
    for bits in (False, True):
        got = {}
        for r in decision.recursive(d, spec, bits=bits).collect():
            got.setdefault(r.doc_id, []).append((r.place, r.category, r.score))
        for k, s in docs:
            left, want = [0, 1, 2], []
            while left:
                terms = {i: sorted((s[j] / (math.log(2) if bits else 1) + math.log([2, 1, 1][j] / 4) + math.log(1 if i == j else loss[j][i]) for j in left), reverse=True) for i in left}
                at = min(left, key=lambda i: (terms[i], i))  # noqa: B023
                want.append(("xyz"[at], terms[at][0]))
                left.remove(at)
            own = sorted(got[k])
            assert [c for _, c, _ in own] == [c for c, _ in want]
            assert all(abs(a - b) < 1e-9 for (_, _, a), (_, b) in zip(own, want, strict=True))


def test_printed_scores_are_decided(spark, tmp_path):
    (tmp_path / "scores").write_text("x 2.00 * 4.0 y 1.00 * 4.0 z 3.00 * 4.0\nx 0.50 * 2.0 y 9.00 * 2.0 z 9.00 * 2.0\n")
    plain = decision.parse(RISK.replace("complexity", "1").replace("{ 2, 1, 1 }", "{ 1, 1, 1 }"))
    got = decision.decide_printed(spark, str(tmp_path / "scores"), plain).orderBy("line_no").collect()
    assert [r.category for r in got] == ["y", "x"]


def test_folds_meet_their_own_models(spark):
    f = spark.createDataFrame([("m", 0, 1, "a", 1.0), ("m", 1, 1, "a", 3.0)], "model string, fold int, ord int, gram string, lam double")
    m = spark.createDataFrame([("m", 0, 1, 0.5), ("m", 1, 1, 0.25)], "model string, fold int, max_order int, log_z double")
    c = spark.createDataFrame([(1, 0, 1, "a", 2), (2, 1, 1, "a", 1)], "doc_id int, fold int, ord int, gram string, cnt long")
    got = {r.doc_id: r.score for r in score.score(c, f, m, ref=F.lit(0.0), by="fold").collect()}
    assert got == {1: 2 * 0.5, 2: 2.75}


def test_patterns_and_routing(spark):
    d = spark.createDataFrame([(1, "abc 12 abd")], "doc_id int, text string")
    t = tx.all_matches(F.col("text"), [("(a)b([cd])", [1, 2]), ("[0-9]", [])])
    assert d.select(t.alias("t")).first().t == ["a c", "a d", "1", "2"]
    groups = []
    for pattern, name in (("[0-9]", "digits"), ("[a-z]", "letters")):
        grams = lambda x, p=pattern: x.select("doc_id", F.explode(tx.matches(F.col("text"), p, [])).alias("gram"), F.lit(1).alias("ord"))
        learned = fit.fit(fit.with_uniform(ft.counts(grams(d).withColumn("model", F.lit(name)), "model")), 1)
        groups.append((grams, *learned))
    assert {r.model: (r.complexity, r.n_hits) for r in score.score_by_options(d, groups).collect()} == {"digits": (2, 2), "letters": (6, 6)}
    assert tx.default_tokenizer("email") == "adp" and tx.default_tokenizer("text") == "alpha"
    b = spark.createDataFrame([("a\x01b",), ("a\tb",), (None,)], "t string")
    assert [r.b for r in b.select(tx.is_binary(F.col("t")).alias("b")).collect()] == [True, False, False]


def test_dump_is_read_back(spark):
    f, _ = fit.fit(fit.with_uniform(ft.counts(ft.gram_rows(spark.createDataFrame([("m", "one two two"), ("m", "x")], "model string, text string"), 2), "model")), 2)
    got = {(r.model, r.ord, r.gram): (r.cnt, round(r.lam, 3)) for r in models.read_dump(models.dump(f)).collect()}
    want = {(r.model, r.ord, r.gram): (r.cnt, r.lam) for r in f.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 0.001 for k in want)


def test_listing(spark, tmp_path):
    m = spark.createDataFrame([(1, "From: Somebody With A Long Name <a@b>\nSubject: hi\n there\n\nSubject: not this"), (2, "x")], "doc_id int, raw string")
    assert [r.description for r in evaluate.describe(m).orderBy("doc_id").collect()] == ["[Somebody With A Long] hi there", "[] "]
    assert [r.tagged for r in evaluate.tagged(m, m.where("doc_id = 2")).orderBy("doc_id").collect()] == [False, True]
    evaluate.categorize(m, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, best string"), f"{tmp_path}/c")
    assert {(r.doc_id, r.best) for r in spark.read.parquet(f"{tmp_path}/c").collect()} == {(1, "a"), (2, "b")}

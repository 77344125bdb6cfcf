import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import special
from wordloom.operators import compare, decision, evaluate, fit, measures, score
from wordloom.operators import features as ft
from wordloom.sources import models
from wordloom.streaming import lines

FOX = "The quick brown fox jumped over the lazy dog"
TEXTS = [(1, "a", "red green blue red"), (2, "a", "green red red"), (3, "b", "one two three two"), (4, "b", "three one one blue")]


def learned(spark, rows=None, order=1, **more):
    d = spark.createDataFrame(rows or TEXTS, "doc_id long, model string, text string").select("model", "text")
    c = ft.counts(ft.token_rows(d) if order == 1 else ft.gram_rows(d, order), "model")
    return fit.fit(fit.with_uniform(c), order, **more)


@pytest.mark.parametrize("quality, rounds, log_z", [(1, 28, 3.146), (2, 50, 3.629)])
def test_known_fits(spark, quality, rounds, log_z):
    _, m = learned(spark, [(1, "m", FOX)], quality=quality)
    r = m.first()
    assert r.iterations == rounds and abs(r.log_z - log_z) < 0.002


def test_entropy_of_a_line(spark):
    c = ft.counts(ft.token_rows(spark.createDataFrame([("m", FOX)], "model string, text string")), "model")
    assert abs(fit.corpus_entropy(c).first().shannon - 2.043) < 0.001


def test_spread_classes_give_the_same(spark):
    a, b = (learned(spark, class_limit=n) for n in (1000, 0))
    key = lambda x: sorted(map(tuple, x.select("model", "gram", "lam").collect()))
    assert key(a[0]) == key(b[0])


LONG = [(1, "m", "a" * 30 + " " + "b" * 30 + " bb " + "a" * 30 + " c bb bb " + "d" * 24)]


def by_hand(counts, order, quality, passes):
    """{(ord, gram): weight}, log Z, rounds: feature by feature, round by round."""
    q_div, q_lam, q_z = fit.QUALITY[quality]
    lam = dict.fromkeys(counts, 0.0)
    dref = {(r, g): (len(g.replace(" ", "")) + r if r == 1 else len(g) + 1) * measures.UNIFORM for r, g in counts}
    suffix = lambda r, g: sum(lam.get((k, " ".join(g.split(" ")[-k:])), 0.0) for k in range(1, r))
    total_rounds, z_before, log_z = 0, 0.0, 0.0
    for _ in range(passes):
        for r in range(1, order + 1):
            own = [x for x in counts if x[0] == r]
            xi = sum(counts[x] for x in own)
            fixed = 1 + sum(math.exp(r * suffix(*x) + dref[x]) * math.expm1(r * lam[x]) for x in counts if x[0] < r)
            z = lambda: math.log(fixed + sum(math.exp(r * suffix(*x) + dref[x]) * math.expm1(r * lam[x]) for x in own)) / r  # noqa: E731, B023
            div = lambda at: -at + sum(lam[x] * counts[x] for x in own) / xi  # noqa: E731, B023
            log_z = z()
            d = div(log_z)
            for _ in range(50):
                change, old = 0.0, log_z
                for x in own:
                    new = (math.log(counts[x]) - math.log(xi) - dref[x]) / r + old - suffix(*x)
                    new = max(0.0, min(max(new, lam[x] - 100), lam[x] + 100))
                    change = max(change, abs(new - lam[x]))
                    lam[x] = int(new * 32) / 32
                log_z, total_rounds = z(), total_rounds + 1
                d, before = div(log_z), d
                if abs(d - before) <= q_div and change <= q_lam and abs(log_z - old) <= q_z:
                    break
        if abs(1 - z_before / log_z) < 0.01:
            break
        z_before = log_z
    return lam, log_z, total_rounds


@pytest.mark.parametrize("rows, order, quality", [(LONG, 1, 1), (LONG, 1, 3), (LONG, 1, 4), (TEXTS[:2], 2, 1), (TEXTS[:2], 2, 4)])
def test_fits_by_hand(spark, rows, order, quality):
    d = spark.createDataFrame(rows, "doc_id long, model string, text string").select("model", "text")
    c = ft.counts(ft.gram_rows(d, order), "model")
    lam, log_z, rounds = by_hand({(x.ord, x.gram): x.cnt for x in c.collect()}, order, quality, 50 if quality == 4 else 1)
    for limit in (1000, 0):
        f, m = fit.fit(fit.with_uniform(c), order, quality, class_limit=limit)
        assert {(x.ord, x.gram): x.lam for x in f.collect()} == lam
        assert abs(m.first().log_z - log_z) < 1e-9 and m.first().iterations == rounds


def test_grams_without_unigrams_are_of_order_one(spark):
    rows = spark.createDataFrame([("a", 2, "x y", 1), ("a", 3, "x y z", 2), ("b", 1, "x", 1), ("b", 2, "x y", 1), (None, 2, "q r", 4)], "model string, ord int, gram string, cnt long")
    got = {(x.model, x.gram): x.ord for x in ft.or_forced(rows, "model").collect()}
    assert got == {("a", "x y"): 1, ("a", "x y z"): 1, ("b", "x"): 1, ("b", "x y"): 2, (None, "q r"): 1}
    assert {x.ord for x in ft.forced(rows).collect()} == {1} and ft.or_forced(rows.limit(0), "model").count() == 0


def test_min_count_gives_no_weight(spark):
    f, _ = learned(spark, [(1, "m", "The quick the brown brown brown fox jumped over the over lazy dog")], min_count=1)
    assert f.where("lam = 0").count() == 5


def test_scores_against_plain_sums(spark):
    f, m = learned(spark)
    docs = spark.createDataFrame([(9, "red red purple"), (10, "two"), (11, "")], "doc_id long, text string")
    got = {(r.doc_id, r.model): r for r in score.score(ft.counts(ft.token_rows(docs), "doc_id"), f, m).collect()}
    lam = {(r.model, r.gram): r.lam for r in f.collect()}
    z = {r.model: r.log_z for r in m.collect()}
    for (d, model), r in got.items():
        words = {9: ["red", "red", "purple"], 10: ["two"]}[d]
        want = sum(lam.get((model, w), 0) + (len(w) + 1) * measures.UNIFORM - z[model] for w in words)
        assert abs(r.score - want) < 1e-9 and r.complexity == len(words) and r.n_hits == sum((model, w) in lam for w in words)
    p = score.posterior(score.score(ft.counts(ft.token_rows(docs), "doc_id"), f, m))
    assert all(abs(r.t - 100) < 1e-9 for r in p.groupBy("doc_id").agg(F.sum("p").alias("t")).collect())
    best = {r.doc_id: (r.best, r.map_index) for r in score.best(score.score(ft.counts(ft.token_rows(docs), "doc_id"), f, m)).collect()}
    assert best == {9: ("a", 1), 10: ("b", 2)}


def test_bigram_suffix_weights(spark):
    f, m = learned(spark, order=2)
    rows = {(r.model, r.gram): r for r in f.collect()}
    for (model, gram), r in rows.items():
        if r.ord == 2:
            last = gram.split(" ")[-1]
            assert r.ltrms == (rows[model, last].lam if (model, last) in rows else 0.0)
    assert {r.max_order for r in m.collect()} == {2}


def test_save_load_and_refusals(spark, tmp_path):
    f, m = learned(spark)
    models.save(f, m, f"{tmp_path}/m", {"order": "1"})
    g, n = models.load(spark, f"{tmp_path}/m", {"order": "1"})
    assert sorted(map(tuple, g.select("model", "gram", "lam").collect())) == sorted(map(tuple, f.select("model", "gram", "lam").collect()))
    assert n.count() == 2 and models.dump(g).count() == f.count()
    with pytest.raises(ValueError):
        models.load(spark, f"{tmp_path}/m", {"order": "2"})
    (tmp_path / "other").mkdir()
    with pytest.raises(FileExistsError):
        models.save(f, m, f"{tmp_path}/other")
    assert all(all(r[1:]) for r in evaluate.integrity(f, m).collect())


def test_divergences(spark):
    f, m = learned(spark)
    r = compare.kl(f, m).first()
    assert r.d_ab > 0 and r.d_ba > 0
    same = compare.kl(f.where("model = 'a'").unionByName(f.where("model = 'a'").withColumn("model", F.lit("c"))), m.where("model = 'a'").unionByName(m.where("model = 'a'").withColumn("model", F.lit("c")))).first()
    assert abs(same.d_ab) < 1e-12
    assert 0 <= compare.chernoff(compare.sweep(f, m)).first().beta <= 1


def test_decisions(spark):
    s = spark.createDataFrame([(1, "x", -10.0, 4.0), (1, "y", -11.0, 4.0), (2, "x", -30.0, 9.0), (2, "y", -11.0, 9.0)], "doc_id long, model string, score double, complexity double")
    spec = decision.parse('categories { x, y } prior { 1, 1 } loss_matrix { "pay ([0-9]+)" y [ $1 ^ 2 + 1, 0 ] "" x [ 0, 1 ] "" y [ 1, 0 ] }')
    texts = spark.createDataFrame([(1, "pay 50 now"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.category, r.risk) for r in decision.decide(s, spec, texts).collect()}
    assert got[1][0] == "y" and abs(got[1][1] - (-10 + math.log(0.5))) < 1e-9  # deciding x would cost 2501 e^-11
    assert got[2][0] == "y"
    assert decision.parse("categories{a} prior{1} loss_matrix{ \"\" a [ 2 + 3 * 4 - 1 ] }").rows[0].losses[0] == ("+", ("num", 2.0), ("-", ("*", ("num", 3.0), ("num", 4.0)), ("num", 1.0)))
    with pytest.raises(ValueError):
        decision.parse("categories { a, b } prior { 1 } loss_matrix { }")


def test_special_functions():
    assert abs(special.gamma_upper(1.0, 2.0) - math.exp(-2)) < 1e-10
    assert abs(special.gamma_upper(0.5, 1.0) - math.erfc(1.0)) < 1e-10
    assert special.gamma_p(-1, 1, 1) == 0 and special.gamma_p(math.log(2), 1, 1) in (999, 1000)
    assert special.unambiguity([1.0, 9.0], [0.1, 0.1]) == 100 and special.unambiguity([1.0, 1.0], [0.1, 0.1]) == 0
    assert abs(sum(special.least_probability(k, [1, 1.2, 3], [0.5, 0.7, 0.2]) for k in range(3)) - 1) < 0.02


def test_matrices():
    n = np.zeros((256, 256))
    n[1, 97], n[97, 98], n[98, 1] = 40, 30, 30
    d, m = measures.dirichlet(n), measures.maxent(n)
    assert d[1, 97] > -1 and d[97, 99] < -5 and m[1, 97] > m[1, 98]
    assert (m * 32 == np.floor(m * 32)).all()


def test_evaluation(spark):
    p = spark.createDataFrame([(i, "a" if i % 3 else "b", "a") for i in range(12)], "doc_id long, truth string, best string")
    c = {(r.truth, r.predicted): (r.n, r.recall) for r in evaluate.confusion(p).collect()}
    assert c == {("a", "a"): (8, 100.0), ("b", "a"): (4, 100.0)}
    e = sorted(map(tuple, evaluate.cumulative_errors(p, "doc_id", stretch=5).collect()))
    assert [x[1] for x in e] == list(range(1, 13)) and e[-1][2] == 4
    counts = spark.createDataFrame([("m", 0, "x", 2), ("m", 1, "x", 3), ("m", 1, "y", 1)], "model string, fold int, gram string, cnt long")
    assert {tuple(r) for r in evaluate.training_sets(counts, 2).collect()} == {(0, "m", "x", 3), (0, "m", "y", 1), (1, "m", "x", 2)}


def test_streams(spark, tmp_path):
    f, m = learned(spark)
    models.save(f, m, f"{tmp_path}/model")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("red green\ntwo three one\n")
    source = spark.readStream.text(f"file://{tmp_path}/in").select(F.col("value").alias("line"), F.lit(0).alias("line_id"))
    kept = []
    q = lines.filter_lines(spark, source, f"{tmp_path}/model", ["b"], lambda d, n: kept.extend(r.line for r in d.collect()), f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert kept == ["two three one"]
    q = lines.learn_stream(source.select(F.lit("m").alias("model"), F.col("line").alias("text")), f"{tmp_path}/counts", f"{tmp_path}/ck2")
    q.processAllAvailable()
    q.stop()
    assert lines.learned(spark, f"{tmp_path}/counts").count() == 5


def test_train_on_error(spark, tmp_path):
    d = spark.createDataFrame([(i, "ab"[i % 2], ["red green", "one two"][i % 2]) for i in range(8)], "doc_id long, truth string, text string")
    batches = [d.where(f"doc_id >= {k} and doc_id < {k + 4}") for k in (0, 4)]
    out = [p.collect() for p in lines.train_on_error(spark, batches, lambda c: fit.fit(fit.with_uniform(c)), f"{tmp_path}/toe")]
    assert all(r.best is None for r in out[0]) and all(r.best == r.truth for r in out[1])


def test_dirichlet_takes_no_memory_by_its_counts():
    n = np.zeros((256, 256))
    n[1:4, 1:4] = [[5, 10**7, 0], [70_000, 2, 3], [4, 1, 300_000]]
    tracemalloc.start()
    w = measures.dirichlet(n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and np.isfinite(w[1:4, 1:4][n[1:4, 1:4] > 0]).all()
    for m in (2, 3, 70_000, 200_001):  # sums beyond the table are those of adding up
        got = [x[0] for x in measures._power_sums(np.array([m]))]
        assert np.allclose(got, [sum(1 / k**p for k in range(3, m + 1)) for p in (1, 2)], rtol=1e-12)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_counts_within_rows(spark):
    texts = [(1, "b a b\nB c"), (2, ""), (3, None), (4, "a")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(1, 1, "a", 1), (1, 1, "b", 3), (1, 1, "c", 1), (4, 1, "a", 1)}
    got = ft.token_counts(d, "doc_id")
    assert {tuple(r) for r in got.collect()} == want and exchanges(got) == 0  # no counts are sent
    twice = d.unionByName(d.where("doc_id = 4"))
    assert {tuple(r) for r in ft.token_counts(twice, "doc_id").collect()} == want - {(4, 1, "a", 1)} | {(4, 1, "a", 2)}
    by_line = {(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 1), (4, 0, "a", 1)}
    assert {(r.doc_id, r.line_no, r.gram, r.cnt) for r in score.line_counts(d).collect()} == by_line


@pytest.mark.parametrize("limit", [0, 8, 20, 10_000])
def test_scores_whatever_is_broadcast(spark, monkeypatch, limit):
    """Grams that are looked up where they are counted, and those that are sent, give the sums of a plain join."""
    f, m = learned(spark, [*TEXTS, (5, "a", "red " * 40), (6, "b", "one " * 9)])
    c = ft.token_counts(spark.createDataFrame([(1, "red red one nowhere"), (2, "nowhere"), (3, "two blue"), (4, "")], "doc_id long, text string"), "doc_id")
    ref = measures.uniform_ref(F.col("gram"), F.lit(1))
    plain = c.crossJoin(m.select("model", "log_z")).join(f.select("model", "gram", "lam"), ["model", "gram"], "left").withColumn("x", F.coalesce("lam", F.lit(0.0)) + ref - F.col("log_z"))
    n = F.col("cnt")
    plain = plain.groupBy("doc_id", "model").agg(F.sum(n * F.col("x")).alias("score"), F.sum(n).alias("n"), F.coalesce(F.sum(F.when(F.col("lam").isNotNull(), n)), F.lit(0)).alias("hits"), F.sum(n * F.log(n)).alias("c"))
    want = {(r.doc_id, r.model): (round(r.score, 9), r.n, r.hits, round(math.log(r.n) - r.c / r.n, 9)) for r in plain.collect()}
    monkeypatch.setattr(score.lookup, "LIMIT", limit)
    got = {(r.doc_id, r.model): (round(r.score, 9), r.n_tokens, r.n_hits, round(r.shannon, 9)) for r in score.score(c, f, m).collect()}
    assert got == want


def test_scores_send_a_row_a_document(spark):
    f, m = learned(spark)
    c = ft.token_counts(spark.createDataFrame([(k, "red one") for k in range(9)], "doc_id long, text string"), "doc_id")
    assert exchanges(score.score(c, f, m)) == 1  # by document alone, where counts and grams were dealt out, too


@pytest.mark.parametrize("order, more", [(2, {}), (3, {"min_count": 1}), (2, {"class_limit": 0})])
def test_passes_over_features_that_are_alike(spark, order, more):
    """Quality 4 goes over one row for features that keep the same weight, and gives each what passes over all features give it."""
    rows = [(k, "ab"[k % 2], " ".join(["red", "green", "blue", "one", "two"][(k * j) % 5] for j in range(1, 9)) + ".") for k in range(1, 20)]
    d = spark.createDataFrame(rows, "doc_id long, model string, text string").select("model", "text")
    c = fit.with_uniform(ft.counts(ft.gram_rows(d, order), "model"))
    f, m = fit.fit(c, order, 4, **more)
    every = c.withColumn("cls", F.lit(0))
    g, n = fit._passes(every, order, more.get("min_count", 0), more.get("class_limit", fit.CLASS_LIMIT), None)
    key = lambda x: sorted((r.model, r.ord, r.gram, r.cnt, r.dref, round(r.ltrms, 9), r.lam) for r in x.collect())
    assert key(f) == key(g)
    figures = lambda x: sorted((r.model, r.iterations, round(r.log_z, 9), round(r.divergence, 9), r.n_tokens, r.n_features) for r in x.collect())
    assert figures(m) == figures(n)
    alike = fit._alike(every.withColumn("lam0", F.lit(0.0)), order)
    assert alike.count() < c.count() and alike.agg(F.sum("m")).first()[0] == c.count()


@pytest.mark.parametrize("limit", [8, 10_000])
def test_own_divergences_come_with_scores(spark, monkeypatch, limit):
    """Of documents under their own model, without counting and looking them up once more."""
    f, m = learned(spark, [*TEXTS, (5, "a", "red " * 40)])
    d = spark.createDataFrame([(1, "a", "red red one nowhere"), (2, "b", "nowhere"), (3, "b", "two blue"), (4, "a", "")], "doc_id long, model string, text string")
    monkeypatch.setattr(score.lookup, "LIMIT", limit)
    want = {(r.doc_id, r.model): round(r.div, 9) for r in fit.document_divergences(ft.token_counts(d, "model", "doc_id"), f, m).collect()}
    s = score.score(ft.token_counts(d, "doc_id"), f, m, own=True).join(d, ["doc_id", "model"])
    assert {(r.doc_id, r.model): round(r.own_div, 9) for r in s.collect()} == want and len(want) == 3

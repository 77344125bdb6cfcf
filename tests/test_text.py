import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import features as ft

FOX = "The quick brown fox jumped over the lazy dog"
MIXED = "123 xyz Hello234 %*# +123"


@pytest.mark.parametrize(
    "text, tokenizer, case, n, types",
    [
        (FOX, "alpha", False, 9, 8),
        (FOX, "alpha", True, 9, 9),
        (MIXED, "alpha", False, 2, 2),
        (MIXED, "alnum", False, 4, 3),
        (MIXED, "graph", False, 5, 5),
        (MIXED, "adp", False, 6, 5),
        (MIXED, "cef", False, 2, 2),
    ],
)
def test_token_counts(spark, text, tokenizer, case, n, types):
    got = spark.createDataFrame([(text,)], "t string").select(tx.tokens(F.col("t"), tokenizer, case).alias("x")).first().x
    assert (len(got), len(set(got))) == (n, types)


@pytest.mark.parametrize(
    "text, tokenizer, want",
    [
        ("baaaad!!!!! x", "adp", ["baad!!", "x"]),
        ("it's a-b.c foo12 9ab $12.50 ---- <me@x.org>", "cef", ["it's", "a-b.c", "foo12", "9ab", "$12.50", "---", "me", "x.org"]),
        ("a.b.c:d x:y z", "cef2", ["a.b.c", "d", "x:y", "z"]),
        ("", "adp", []),
        ("x" * 65, "alpha", ["x" * 30, "x" * 30, "xxxxx"]),
    ],
)
def test_ruled_tokens(spark, text, tokenizer, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.tokens(F.col("t"), tokenizer).alias("x")).first().x == want


def test_trigrams(spark):
    got = ft.counts(ft.gram_rows(spark.createDataFrame([(1, FOX)], "doc_id long, text string"), 3)).collect()
    assert sum(r.cnt for r in got) == 24 and len(got) == 23


def test_line_end_gram(spark):
    got = ft.gram_rows(spark.createDataFrame([(1, "a b c.\nd")], "doc_id long, text string"), 3).collect()
    assert {"b c ", "c "} <= {r.gram for r in got} and "c d" not in {r.gram for r in got}


def test_overlapping_pattern(spark):
    got = spark.createDataFrame([(MIXED,)], "t string").select(tx.matches(F.col("t"), "([a-z2-9]{2})", [1]).alias("x")).first().x
    assert (len(got), len(set(got))) == (10, 8)


def test_nulls(spark):
    d = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert ft.counts(ft.token_rows(d, "alpha"), "doc_id").count() == 2
    assert ft.doc_entropy(d).count() == 1


def test_merge_and_decimation(spark):
    d = spark.createDataFrame([(i, f"w{'abc'[i % 3]} common") for i in range(30)], "doc_id long, text string")
    whole = ft.counts(ft.token_rows(d.select("text")))
    parts = ft.merge(ft.counts(ft.token_rows(d.where("doc_id < 7").select("text"))), ft.counts(ft.token_rows(d.where("doc_id >= 7").select("text"))))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.select(*whole.columns).collect()))
    assert 0 < ft.decimate(d, 2).count() < 30 and ft.reservoir(d, 5).count() == 5
    assert ft.min_count(whole, -29).count() == 4 and ft.min_count(whole, 10).count() == 1


@pytest.mark.parametrize("order, straddle", [(2, False), (3, False), (3, True)])
def test_gram_rows_in_compiled_code(spark, order, straddle):
    texts = ["a b c.\nd", "", "\n\n", None, "A-b", "one two\nthree.", "Kelvin İstanbul ÉtÉ STRASSE"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ft.gram_rows(d, order, straddle=straddle)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "flatten(" not in plan and "array_join(" not in plan  # the functions that took the time
    t = d.select("doc_id", tx.tokens(F.col("text")).alias("t")) if straddle else ft.line_rows(d).select("doc_id", tx.closed_tokens(F.col("line")).alias("t"))
    want = t.select("doc_id", F.explode(tx.grams(F.col("t"), order)).alias("g")).select("doc_id", "g.ord", "g.gram")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))
    some = ft.gram_rows(d, order, straddle=straddle, least=2)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.where("ord > 1").collect()))


def test_only_ascii_letters_are_folded(spark):
    text = "Kelvin İstanbul ÉtÉ AbC"
    d = spark.createDataFrame([(text,), (text[7:],), (text[17:],)], "t string")
    got = [r.x for r in d.select(tx.tokens(F.col("t")).alias("x")).collect()]
    assert got == [["elvin", "stanbul", "t", "abc"], ["stanbul", "t", "abc"], ["t", "abc"]]

import hashlib
import random
import re

import numpy as np
import pytest

from wordloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    out = {}
    phrases = [("" if i is None else str(i), w) for i, t in items for w in [fold(t)] if w]
    for key, t in docs:
        w, hit, found = fold(t), set(), set()
        for i, p in phrases:
            n = min(10, len(p))
            for s in range(len(p) - n + 1):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == p[s : s + n]:
                        hit |= set(range(k, k + n))
                        found.add(i)
        out[key] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def case(seed):
    r = random.Random(seed)
    v = ["a", "B", "ü9", "c"]
    text = lambda n: "".join(r.choice(v) + r.choice([" ", ", ", "\n", "\x00"]) for _ in range(n))
    items = [(1, text(12)), (2, text(3)), (10, ""), (11, None), (12, "zz yy"), (None, "zz"), (None, "yy yy")]
    docs = [(k, text(r.randrange(60))) for k in range(12)] + [(90, None), (91, ""), (92, "..."), (93, items[0][1]), (94, items[0][1])]
    docs.append((95, text(500) + items[0][1] + "zz! YY"))
    return docs, items


@pytest.mark.parametrize("limit", [500_000, 9])
def test_against_brute_force(spark, tmp_path, limit):
    docs, items = case(limit)
    spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    old, d.find_hits.__defaults__ = d.find_hits.__defaults__, (*d.find_hits.__defaults__[:-1], limit)
    try:
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in d.op1_decontaminate(spark, str(tmp_path)).collect()}
    finally:
        d.find_hits.__defaults__ = old
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.find_hits(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.find_hits(one, items).first().hit_spans == []


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two three! And this"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", "one TWO three")], "item_id string, text string")
    got = {r.doc_id: r.text for r in d.remove_hits(docs, items).collect()}
    assert got == {1: "Keep this. ! And this", 2: None}


def test_index_counts_and_locates():
    r = np.random.default_rng(3)
    s = r.integers(1, 4, 300)
    index = d.FMIndex(s, 3)
    for n in (1, 2, 3):
        p = r.integers(1, 4, (20, n))
        lo, hi = index.search(p)
        for k in range(20):
            want = [i for i in range(300 - n + 1) if (s[i : i + n] == p[k]).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k]))) == want

import random

import numpy as np
import pytest

import corpus_pipeline as c
from wordloom.llm import shingles, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b, n=5):
    def s(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def corpus():
    r = random.Random(8)
    v = [f"word{k}é" for k in range(600)]
    text = lambda n: [r.choice(v) for _ in range(n)]
    shared = text(60)
    docs = []
    for k in range(40):
        docs.append(" ".join(text(r.choice([3, 40, 150])) + (shared if k % 2 else [])))
    for k in range(12):
        base = docs[20 + k % 3].split()
        for _ in range(1 + k % 4):
            base[r.randrange(len(base))] = r.choice(v)
        docs.append(" ".join(base))
    docs += [docs[1], docs[1], None, "", "  ", "a b", "A  b", "a b c"]
    return [(100 - k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(docs)] + [(100, docs[0], "en", "s0", 3)]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(shingles, "OFTEN", 6)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted({min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i in range(len(rows))})
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = shingles.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect()) == want
    assert shingles.keep_one(docs.limit(0)).count() == 0


def test_colliding_keys_drop_no_text(spark, monkeypatch):
    """With one key for all texts, copies still are one and different texts all stay."""
    monkeypatch.setattr(shingles, "_key", lambda text: shingles.F.lit(5).cast("long"))
    rows = [(7, "a b c d e f g"), (3, "a b c d e f g"), (9, "u v w x y z"), (1, "k l m n o p"), (None, "other words"), (5, None), (6, " ")]
    got = shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got.collect()) == [(False, 1), (False, 3), (False, 5), (False, 9), (True, 0)]


def test_stages(spark, tmp_path):
    rows = corpus()
    item = rows[5][1].split()[:15]
    rows += [(500, " ".join(["keep", *item, "this"]), "en", "s1", 9), (501, " ".join(item), "en", "s1", 9)]
    rows += [(600 + k, " ".join(["BUY NOW!!"] * (20 + k)), "en", "s2", 1) for k in range(20)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 600)) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = c.quality_stage(spark, docs, str(tmp_path))
    kept = {x.doc_id for x in good.collect()}
    assert not kept & set(range(600, 620)) and len(kept) > 50
    cut = {x.doc_id: x.text for x in c.decontamination_stage(spark, docs, str(tmp_path)).collect()}
    assert cut[500] == "keep  this" and 501 not in cut and len(cut) == len({r[0] for r in rows}) - 1
    mixed = c.mixing_stage(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    out = c.run(spark, str(tmp_path))
    assert {"slot", "shard"} < set(out.columns) and out.count() > 0
    assert len(c.STAGES) == 5


def test_wide_buckets_lose_no_link(spark):
    """A group of texts edited from one base, more than a bucket compares at once, against all pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for i in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            w[i] = f"x{k}_{i}"
        rows.append((k, " ".join(w)))
    sets = [set(shingles.shingle_set(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(len(rows))})
    got = shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want and 1 < len(want) < 150


@pytest.mark.parametrize("copies", [2, 90])
def test_repeated_lines_lose_no_link(spark, copies):
    """Texts that differ in how often they repeat a line have nearly the same shingle sets; against all pairs, in narrow and wide buckets."""
    r = random.Random(3)
    v = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(12 if copies == 2 else 1):
        base, line = r.choices(v, k=150), r.choices(v, k=12)
        for c in range(copies):
            own = list(base)
            for _ in range(c % 4):
                own[r.randrange(150)] = r.choice(v)
            texts.append(" ".join(own + line * (1 if c % 2 else 30 + c)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(len(texts))})
    got = shingles.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == want and len(want) < len(texts)


def test_stage_links_fingerprints_too(spark, tmp_path):
    """Against brute force of both ways' links: texts within three bits that share under 0.8 of their shingles of five words, and copies of these at 0.8."""
    r = random.Random(4)
    v = [f"w{i}" for i in range(4000)]

    def edited(words, n):
        own = list(words)
        for i in r.sample(range(len(own)), n):
            own[i] = r.choice(v)
        return own

    fp = lambda t: int(simhash.fingerprints([t], 3)[0])
    far = lambda a, b: (fp(a) ^ fp(b)).bit_count()
    texts = []
    while len(texts) < 12:
        base = r.choices(v, k=400)
        a = " ".join(base)
        for _ in range(100):
            b = edited(base, 14)
            d = " ".join(edited(b, 8))
            b = " ".join(b)
            if far(a, b) <= 3 and jaccard(a, b) < 0.8 <= jaccard(b, d) and far(b, d) > 3 and far(a, d) > 3 and jaccard(a, d) < 0.8:
                texts += [a, b, d]
                break
    texts += [" ".join(r.choices(v, k=n)) for n in (1, 3, 5, 60, 400)] + [None, " ", texts[1]]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 or far(texts[i], texts[j]) <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(len(texts))})
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], COLUMNS).repartition(3)
    got = c.near_duplicate_stage(spark, docs, str(tmp_path))
    assert sorted(x.doc_id for x in got.collect()) == want == [0, 3, 6, 9, 12, 13, 14, 15, 16, 17]
    assert c.near_duplicate_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_filters_pass_every_similar_pair():
    r = np.random.default_rng(11)
    for n in (1, 7, 60, 900, 9000):
        for _ in range(30):
            base = r.integers(0, 2**63, n, np.uint64)
            a, b = (np.unique(np.concatenate([base[r.random(n) > 0.08], r.integers(0, 2**63, n // 12, np.uint64)])) for _ in range(2))
            both = np.intersect1d(a, b)
            if not len(both) or len(both) < 0.8 * (len(a) + len(b) - len(both)):
                continue
            size = np.array([len(a), len(b)])
            at = np.array([np.searchsorted(a, both[0]), np.searchsorted(b, both[0])])
            i, j = np.array([0]), np.array([1])
            assert (at < [shingles.prefix_size(len(x), 0.8) for x in (a, b)]).all() and shingles._room(size, at, i, j, 0.8).all()
            for places in (shingles.FOLDED, shingles.PARITIES):
                bits = np.array([np.frombuffer(shingles.parities(x, places), np.uint64) for x in (a, b)])
                assert shingles._parities_allow(bits, size, i, j, 0.8).all()

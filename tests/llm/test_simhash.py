import random

import numpy as np
import xxhash

from wordloom.llm import simhash as s


def fp_of(t):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=3):
    root = dict(enumerate(range(len(fps))))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    v = [f"w{k}é" for k in range(400)]
    docs = []
    for k in range(40):
        w = [r.choice(v) for _ in range(r.choice([1, 2, 3, 60, 300]))]
        docs.append((100 + k, " ".join(w)))
        if len(w) > 50:
            w[7] = "ZZ"
            docs.append((300 - k, "\t".join(w)))
    docs += [(1000, None), (1001, ""), (1002, " \x0c\n"), (7, docs[0][1]), (7, docs[0][1]), (2000, "a b c")]
    spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.doc_id, x.fingerprint, x.component_id) for x in s.op9_simhash(spark, str(tmp_path)).collect())
    fps = [fp_of(t) for _, t in docs]
    c = classes(fps)
    least = {k: min(i for (i, _), x in zip(docs, c) if x == k) for k in c}
    assert got == sorted((i, f"{f:016x}", least[k]) for (i, _), f, k in zip(docs, fps, c))


def test_links_cover_radius_and_hot_buckets(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for d in (1, 2, 3, 4):
            x = b
            for k in r.sample(range(64), d):
                x ^= 1 << k
            fps.add(x)
    fps |= {(base[0] & ~0xFFFFFFFF) | r.getrandbits(32) for _ in range(60)}  # one half in common
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp long")
    for radius in (0, 1, 2, 3):
        want = classes(fps, radius)
        found = [(x.a % 2**64, x.b % 2**64) for x in s.links(df, radius, 1000).collect()]
        assert all((a ^ b).bit_count() <= radius for a, b in found)
        at = {f: k for k, f in enumerate(fps)}
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in found:
            x, y = sorted((find(at[a]), find(at[b])))
            root[y] = x
        assert [find(k) for k in range(len(fps))] == want


def test_empty(spark):
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_pieces(monkeypatch):
    t = " ".join(f"w{i}" for i in range(90))
    want = fp_of(t)
    monkeypatch.setattr(s, "CHUNK", 20)
    assert int(s.fingerprints([None, t, "x", t], 3)[1]) == want

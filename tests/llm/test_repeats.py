import hashlib
import random
from collections import Counter

import pytest

import duckdb
import numpy as np

from wordloom.llm import repeats, substring, suffix


def corpus(seed, unit):
    r = random.Random(seed)
    n = 260 if unit == "words" else 900
    piece = (lambda: " ".join(f"w{r.randrange(300)}" for _ in range(n))) if unit == "words" else (lambda: "".join(r.choice("abcé ") for _ in range(n)))
    base = [piece() for _ in range(8)]
    docs = list(base)
    for b in base[:5]:
        c = list(b)
        for _ in range(3):
            c[r.randrange(len(c))] = r.choice("xyz")
        docs.append("".join(c))
    docs += [base[0][: len(base[0]) // 2] + " " + base[1][len(base[1]) // 3 :], base[2], base[2], None, "", "a b", "same " * 300, "same " * 100, base[3] + "  " + base[3]]
    docs += [base[4][200:] + f" {k} " + base[5][:700] for k in range(6)]
    return [(k, d) for k, d in enumerate(docs)]


def brute_units(raws, window):
    seen = Counter(tuple(u[i : i + window]) for u in raws for i in range(len(u) - window + 1))
    out = []
    for u in raws:
        hit = set()
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                hit |= set(range(i, i + window))
        out.append(hit)
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_words(spark, tmp_path, most, monkeypatch):
    monkeypatch.setattr(repeats.repeated_windows, "__defaults__", (None, most))
    docs = corpus(1, "words")
    spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, k1 int, spans int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.op3_substring_dedup(spark, str(tmp_path)).collect()}
    raws = [(t or "").encode().split() for _, t in docs]
    want = {}
    for (i, _), u, hit in zip(docs, raws, brute_units(raws, 35), strict=True):
        kept = b" ".join(w for k, w in enumerate(u) if k not in hit)
        want[i] = (len(u), len(hit), hashlib.sha256(kept).hexdigest())
    assert got == want


def test_empty(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [20_000, 2])
def test_bytes(spark, tmp_path, most, monkeypatch):
    monkeypatch.setattr(repeats.repeated_windows, "__defaults__", (None, most))
    docs = corpus(2, "bytes")
    spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, a string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(u[i : i + 400] for u in raws for i in range(len(u) - 399))
    want = {}
    for (i, _), u in zip(docs, raws, strict=True):
        hit = np.zeros(len(u) + 1, bool)
        for k in range(len(u) - 399):
            if seen[u[k : k + 400]] > 1:
                hit[k : k + 400] = True
        kept = bytes(b for b, x in zip(u, hit) if not x)
        want[i] = (len(u), int(hit.sum()), int((np.diff(hit.astype(int)) == 1).sum() + hit[0]), hashlib.sha256(kept).hexdigest())
    assert got == want
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(f"select doc_id, n_bytes, n_removed, n_spans, kept_sha256 from ({suffix.ORACLE_SQL})")
    assert {r[0]: r[1:] for r in cur.fetchall()} == want


def test_merged_transforms():
    r = random.Random(4)
    strings = [[r.randrange(1, 4) for _ in range(r.randrange(0, 12))] for _ in range(30)] + [[1, 2] * 8] * 3
    n = [len(x) for x in strings]
    parts, own = [], []
    for k in range(3):
        mine = list(range(k, len(strings), 3))
        own.append(mine)
        parts.append(suffix.Transform(np.array([c for i in mine for c in strings[i]], np.int64), np.array([n[i] for i in mine])))
    z, row, agree = suffix.merge(parts, 40)
    rotations = []
    for s, k in zip(z, row, strict=True):
        p = parts[s]
        at = p.rows[k]
        i = int(np.searchsorted(p.ends, at, side="right"))
        x = strings[own[s][i]] + [0]
        o = at - p.begins[i]
        rotations.append((x[o:] + x[:o]) * 50)
    cut = [x[:40] for x in rotations]
    assert cut == sorted(cut)
    for i in range(1, len(cut)):
        want = next((k for k in range(40) if cut[i][k] != cut[i - 1][k]), 40)
        assert agree[i] == want

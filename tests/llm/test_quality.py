import random
import zlib

import numpy as np

from wordloom.llm import quality as q


def make(r, good):
    w = ["".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 200))]
    if not good:
        w = r.choice([[x.upper() + "!!" for x in w], [x + r.choice(["###", "$$$"]) for x in w], [w[0]] * len(w)])
    return " ".join(w)


def test_held_out_accuracy(spark, tmp_path):
    r = random.Random(3)
    y = {k: int(r.random() < 0.7) for k in range(500)}
    docs = [(k, make(r, v), "x") for k, v in y.items()] + [(900, None, None), (901, "", ""), (5, "again", "")]
    spark.createDataFrame(docs, "doc_id long, text string, stats string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, v) for k, v in y.items()] + [(900, None), (7777, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = q.op7_quality(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in rows)
    held = [x for x in rows if x.held_out and x.doc_id in y and x.doc_id != 5]
    assert sum(x.predicted == y[x.doc_id] for x in held) > 0.95 * len(held)
    # labels of the held-out fold don't matter
    spark.createDataFrame([(k, 1 - v if zlib.crc32(str(k).encode()) % 3 == 1 else v) for k, v in labels if v is not None], "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    again = {(x.doc_id, x.score) for x in q.op7_quality(spark, str(tmp_path)).collect()}
    assert again == {(x.doc_id, x.score) for x in rows}


def test_density_difference():
    r = np.random.default_rng(0)
    x = [r.normal(size=(200, 3)) * s + m for s, m in ((1.0, 0.0), (0.3, 2.0))]
    d = q.Discriminant([200, 200], [a.sum(0) for a in x], [a.T @ a for a in x], 0.0, 0.0)
    for a in x:
        want = []
        for b in x:
            c = np.cov(b.T, bias=True) + 1e-6 * np.eye(3)
            e = a - b.mean(0)
            want.append(-0.5 * np.log(np.linalg.det(c)) - 0.5 * (e @ np.linalg.inv(c) * e).sum(1))
        z = np.clip((want[1] - want[0]) / 2, -30, 30)
        assert np.allclose(d.score(a), 1 / (1 + np.exp(-z)))


def test_one_class_and_none():
    assert q.Discriminant([0, 0], [0, 0], [0, 0]).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert q.Discriminant([0, 4], [0, 0], [0, 0]).score(np.zeros((1, 3))).tolist() == [1.0]
    assert all(np.isfinite(q.statistics(t)).all() for t in (None, "", " ", "!", "a", "\n\n"))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert q.classify(docs, labels).count() == 0

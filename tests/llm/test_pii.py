import hashlib
import random
import re

from wordloom.llm import pii

PAT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def brute(t):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if ok(k, m[0])] for k, p in PAT.items()}


def texts():
    r = random.Random(2)
    out = [None, "", "x", "é😀 a@b.com_x@y.org @c.d a@b@c.d.e..f", "1.2.3.4.5.6.7.8 256.1.1.1 000000255.0.0.0001 1..2.3.4", "4111 1111-1111 1111, 4111111111111112", "+1 (555) 123-4567. +12 +1 2 +1-- +1)3 +123456789", "9" * 30000, "a" * 30000 + "@", "1 2-" * 9000, "+1" + "(" * 9000, "1." * 20000]
    for n in (8, 30, 120):
        for _ in range(120):
            out.append("".join(r.choice("+@.12 34-()a4b111255é") for _ in range(n)))
    return out


def test_base_spans(spark, tmp_path):
    docs = list(enumerate(texts()))
    spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, base string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op2_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    for x in rows:
        b = brute(docs[x.doc_id][1])
        line = ",".join(f"{k}:{s}:{e}" for k in PAT for s, e in b[k])
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(len(b[k]) for k in PAT), docs[x.doc_id]
        assert x.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(x.spans.split(","))


def test_votes_add_spans(spark):
    t = [(k, f"Please e-mail joe{k} [at] host dot com or call 212-555-01{k:02d} today") for k in range(30)] + [(100 + k, f"rows 111-222-33{k:02d} of it") for k in range(30)]
    rows = {x.doc_id: x for x in pii.find(spark.createDataFrame(t, "doc_id long, text string")).collect()}
    assert all(len(rows[k].added_email) == 1 and len(rows[k].added_phone) == 1 for k in range(30))
    s = rows[3].added_email[0]
    assert t[3][1][s["start"] : s["end"]] == "joe3 [at] host dot com"


def test_estimate_prefers_agreement():
    counts = {("phone", (1, 1, 1)): 50, ("phone", (-1, 0, 0)): 80, ("phone", (1, 0, 0)): 5}
    p, rates = pii.estimate(counts)
    assert p["phone", (1, 1, 1)] > 0.9 > 0.5 > p["phone", (-1, 0, 0)]
    w = pii.train(counts, p)
    z = lambda v: sum(a * b for a, b in zip(w, pii._features("phone", v)))
    assert z((1, 1, 1)) > 0 > z((-1, 0, 0))
    assert all(0 < a < 1 and 0 < b < 1 for a, b in rates.values())


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_loose_address_is_gated(spark):
    """Whatever the loose pattern finds passes the test that spares other texts the scan."""
    r = random.Random(3)
    t = [f"mail bob{r.choice([' ', ''])}{a}{r.choice([' ', ''])}host{r.choice([' ', ''])}{d}{r.choice([' ', '', 'x-'])}com now" for a in ("[at]", "(at)", "{at}", " at ") for d in ("[dot]", "(dot)", ".", " dot ", "{dot}") for _ in range(12)]
    rows = spark.createDataFrame([(x,) for x in t], "t string").selectExpr("t", f"rlike(t, r'{pii.CANDIDATES['email']}') as loose", f"rlike(t, r'{pii.AT_WORD}') as gate").collect()
    assert sum(x.loose for x in rows) > 50 and all(x.gate for x in rows if x.loose)

"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation
estimates how reliable they are, and a classifier trained on its posteriors decides.

Base spans (exact patterns with their checks) always stand. Looser candidates of each kind are spans
that the base patterns leave out: obfuscated addresses ("name [at] host dot tld"), numbers with
separators that the base patterns don't take, and undersigned numbers after a word that announces
them. Three labelers vote 1, 0 or abstain on each candidate: a pattern labeler on its form, a
gazetteer labeler on known endings and prefixes, a context labeler on announcing words before it.
Votes are counted by (kind, votes, size and marks of the span), at most 27 x 16 rows a kind; EM runs over these counts and gives each
labeler's hit rates and each combination's posterior; a logistic regression on the kind, the votes and the
span's size and marks, fitted to the posteriors, is the final classifier, and candidates over one half are added
where they don't overlap a base span or an earlier addition of their kind.

Only DataFrame and SQL functions touch rows; the driver handles the bounded table of counts.

Defined cases: a null text is empty, has no spans, and the hash is that of an empty string; texts
of any length are scanned whole with patterns that can't backtrack over them; repeated rows are
treated one by one; without candidates nothing is added; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")

# Possessive, and begun only where a run begins or the last match ended: what a pattern that may
# start anywhere would match, in linear time.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\.|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?\[?\.\]?\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[./_\x20-]{1,2}[0-9]{4}+){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20./-][0-9]{3}[\x20./-][0-9]{4}(?![0-9])",
}
# What every loose address holds. More texts may pass: it only spares scanning the others.
AT_WORD = r"[\[({]at[\])}]|\x20at\x20{1,2}[A-Za-z0-9-]+\x20{0,2}(?:\.|[\[(]?dot)"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|reach)[^\n]{0,24}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|login|node)[^\n]{0,24}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|account|pay)[^\n]{0,24}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|number)[^\n]{0,24}$",
}
# Endings of host names.
ENDINGS = """
com org net edu gov mil int info biz name io ai app dev co me tv cloud online site tech
ar at au be br ca ch cl cn cz de dk es eu fi fr gr hk hu id ie il in it jp kr mx my nl no nz pl pt ro ru se sg th tr tw ua uk us za
""".split()
GAZETTEER = {
    "email": rf"(?i)\b(?:{"|".join(ENDINGS)})$",
    "ip": r"^(?:10|127|172|192)\D",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65)",
    "phone": r"^(?:00|\(?[2-9][0-9]{2}\)?[\x20./-][2-9])",
}
STRICT = {
    "email": r"(?i)(?:\[at\]|\(at\)|\{at\}).*(?:\.|dot)",
    "ip": r"\[\.\]",
    "card": r"^\d{4}([./_\x20-]{1,2})\d{4}\1\d{4}\1\d{4}$",
    "phone": r"^(?:00\d{1,3}[\x20.-]?)?(?:\(\d{3}\)\x20\d{3}-\d{4}|\d{3}([./-])\d{3}\1\d{4})$",
}


def _digits(s):
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits):
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    double = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, double(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _holds(kind: str, s):
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.right(F.concat(F.lit("000"), p), F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    d = _digits(s)
    if kind == "card":
        return F.length(d).between(13, 19) & _luhn(F.when(F.length(d) <= 19, d).otherwise(F.lit("0")))
    return F.length(d).between(9, 15)


_NO_SPANS = "cast(array() as array<struct<start:int,end:int,s:string,before:string>>)"
NEEDS = {"email": "has_at", "ip": "has_digit", "card": "has_digit", "phone": "has_plus"}
LOOSE_NEEDS = {"email": "has_at_word", "ip": "has_digit", "card": "has_digit", "phone": "has_digit"}


def _scan(d: DataFrame, patterns: dict[str, str], needs: dict[str, str], name: str) -> DataFrame:
    """d with <name>_<kind>: arrays of struct(start, end, s, before) of the matches in text, in code points.

    Matches and the gaps between them are columns of their own, so that each is made once; a text
    that lacks what every match has isn't scanned.
    """
    none = F.expr("cast(array() as array<string>)")
    kinds = list(patterns)
    found = {f"{name}_s_{k}": F.when(F.col(needs[k]), F.regexp_extract_all("text", F.lit(f"({patterns[k]})"), F.lit(1))).otherwise(none) for k in kinds}
    d = d.withColumns(found)
    gaps = {f"{name}_g_{k}": F.when(F.size(f"{name}_s_{k}") > 0, F.split("text", patterns[k], -1)).otherwise(none) for k in kinds}
    d = d.withColumns(gaps)
    d = d.withColumns({f"{name}_{k}": _located(F.col(f"{name}_s_{k}"), F.col(f"{name}_g_{k}")) for k in kinds})
    return d.drop(*found, *gaps)


CHUNK = 256
BEFORE = 40


def _by_chunk(items, work):
    """work(all items, chunk, place of its first from 1) of each CHUNK of an array, flattened.

    What is quadratic in work is so in CHUNK alone; what remains is a pass over the whole array for each chunk.
    """
    starts = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(CHUNK))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(F.array(items), lambda a: F.flatten(F.transform(starts(a), lambda i: work(a, F.slice(a, i, F.lit(CHUNK)), i))))[0]


def _length(a, m):
    return a + F.length(m["g"]) + F.length(m["s"])


def _tail(a, m):
    return F.right(F.concat(a, m["g"], m["s"]), F.lit(BEFORE))


def _located(found, gaps):
    """Matches with the gaps before them as struct(start, end, s, before): before has the BEFORE characters that come before, if there are as many."""
    pairs = F.arrays_zip(found.alias("s"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    sized = _by_chunk(pairs, lambda a, own, i: F.array(F.struct(own.alias("own"), F.aggregate(own, F.lit(0), _length).alias("n"), _tail_of(a, i).alias("tail"))))

    def reached(acc, c):
        return F.struct((acc["at"] + c["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def chunks(z):
        at = F.aggregate(z, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), reached)["out"]
        return F.flatten(F.transform(F.arrays_zip(z.alias("c"), at.alias("at")), lambda x: _walked(x["c"], x["at"])))

    return F.transform(F.array(sized), chunks)[0]


def _tail_of(a, i):
    """The text before the match of place i: of the last BEFORE matches and their gaps, each of which has a character at least."""
    first = F.greatest(i - BEFORE, F.lit(1))
    return F.aggregate(F.slice(a, first, i - first), F.lit(""), _tail)


def _walked(chunk, at):
    def step(acc, m):
        start = acc["at"] + F.length(m["g"])
        end = start + F.length(m["s"])
        before = F.right(F.concat(acc["tail"], m["g"]), F.lit(BEFORE))
        span = F.struct(start.alias("start"), end.alias("end"), m["s"].alias("s"), before.alias("before"))
        return F.struct(end.alias("at"), _tail(acc["tail"], m).alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(chunk["own"], F.struct(at.alias("at"), chunk["tail"].alias("tail"), F.expr(_NO_SPANS).alias("out")), step)["out"]


def _votes(kind: str, m):
    vote = lambda yes, else_: F.when(yes, F.lit(1)).otherwise(F.lit(else_))
    valid = _holds(kind, F.regexp_replace(m["s"], r"[\[\]\x20]", "")) if kind == "ip" else (F.length(_digits(m["s"])) == 16) & _luhn(_digits(m["s"])) if kind == "card" else F.lit(True)
    form = F.when(~valid, F.lit(0)).otherwise(vote(m["s"].rlike(STRICT[kind]), -1))
    size = F.least(F.floor(F.length(m["s"]) / 8), F.lit(3)).cast("int")
    marks = F.least(F.length(F.regexp_replace(m["s"], "[A-Za-z0-9]", "")), F.lit(3))
    known = vote(m["s"].rlike(GAZETTEER[kind]), 0 if kind in ("card", "phone") else -1)
    return F.struct(form.alias("form"), known.alias("known"), vote(m["before"].rlike(CONTEXT[kind]), 0).alias("context"), size.alias("size"), marks.alias("marks"))


def _candidates(kind: str, loose, base):
    """Loose matches that overlap no base span of any kind, with votes."""

    def free(own, every):
        first, last = own[0]["start"], F.element_at(own, -1)["end"]
        near = F.filter(every, lambda b: (b["start"] < last) & (first < b["end"]))
        return F.transform(F.array(near), lambda n: F.filter(own, lambda m: ~F.exists(n, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))[0]

    found = F.transform(F.array(base), lambda every: _by_chunk(loose, lambda _, own, i: free(own, every)))[0]
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _votes(kind, m).alias("votes")))


LABELERS = ("form", "known", "context")
SHAPE = ("size", "marks")


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50):
    """EM over counts of (kind, votes). Returns posteriors by (kind, votes) and hit rates by (kind, labeler).

    A labeler votes 1 on true spans with its sensitivity and 0 on false ones with its specificity;
    abstentions tell nothing. Rates start at 0.8, and every one has a prior of four votes at 0.8,
    so that labelers stay better than chance with few votes.
    """
    posterior: dict = {}
    rates: dict = {}
    for kind in KINDS:
        own = {v: n for (k, v), n in counts.items() if k == kind}
        share, rate = 0.5, [(0.8, 0.8)] * 3
        for _ in range(rounds if own else 0):
            p = {}
            for v in own:
                a, b = math.log(share), math.log(1 - share)
                for x, (sens, spec) in zip(v[:3], rate, strict=True):
                    if x >= 0:
                        a += math.log(sens if x else 1 - sens)
                        b += math.log(1 - spec if x else spec)
                p[v] = 1 / (1 + math.exp(min(50, max(-50, b - a))))
            total = sum(own.values())
            share = min(0.99, max(0.01, (sum(n * p[v] for v, n in own.items()) + 1) / (total + 2)))
            rate = []
            for i in range(3):
                yes = sum(n * p[v] for v, n in own.items() if v[i] >= 0)
                no = sum(n * (1 - p[v]) for v, n in own.items() if v[i] >= 0)
                hit = sum(n * p[v] for v, n in own.items() if v[i] == 1)
                miss = sum(n * (1 - p[v]) for v, n in own.items() if v[i] == 0)
                rate.append((min(0.99, (hit + 3.2) / (yes + 4)), min(0.99, (miss + 3.2) / (no + 4))))
            posterior |= {(kind, v): x for v, x in p.items()}
        rates |= {(kind, name): r for name, r in zip(LABELERS, rate, strict=True)}
    return posterior, rates


def _features(kind: str, v: tuple[int, ...]) -> list[float]:
    """Of the kind, the three votes, and the span's size (in steps of eight characters, at most 3) and marks (at most 3)."""
    x = [1.0] + [float(kind == k) for k in KINDS]
    for i in range(3):
        x += [float(v[i] == 1), float(v[i] == 0)]
    return x + [k / 3 for k in (v[3:] or (0, 0))]


def train(counts: dict, posterior: dict, rounds: int = 400, rate: float = 1.0, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic regression fitted to the posteriors, each combination by its share of rows."""
    w = [0.0] * len(_features(KINDS[0], (0, 0, 0)))
    total = sum(counts.values())
    rows = [(_features(k, v), posterior[k, v], n / total) for (k, v), n in sorted(counts.items())]
    for _ in range(rounds if rows else 0):
        g = [decay * a for a in w]
        for x, p, n in rows:
            e = n * (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - p)
            g = [a + e * b for a, b in zip(g, x, strict=True)]
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def _probability(w: list[float], kind: str, votes):
    z = F.lit(w[0] + w[1 + KINDS.index(kind)])
    for i, name in enumerate(LABELERS):
        z = z + F.when(votes[name] == 1, F.lit(w[5 + 2 * i])).when(votes[name] == 0, F.lit(w[6 + 2 * i])).otherwise(0.0)
    for i, name in enumerate(SHAPE):
        z = z + votes[name] * F.lit(w[11 + i] / 3)
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base_<kind>, added_<kind>): arrays of struct(start, end) for each kind."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    d = d.select("doc_id", "text", t.contains("@").alias("has_at"), t.contains("+").alias("has_plus"), t.rlike("[0-9]").alias("has_digit"), t.rlike(AT_WORD).alias("has_at_word"))
    d = _scan(d, PATTERNS, NEEDS, "base")
    d = d.withColumns({f"base_{k}": _plain(_holding(k, F.col(f"base_{k}"))) for k in KINDS})
    d = _scan(d, CANDIDATES, LOOSE_NEEDS, "loose").withColumn("base", F.concat(*[f"base_{k}" for k in KINDS]))
    d = d.select("doc_id", *[f"base_{k}" for k in KINDS], *[_candidates(k, F.col(f"loose_{k}"), F.col("base")).alias(f"loose_{k}") for k in KINDS])
    d = common.materialize(d, "spans")
    votes = F.flatten(F.array(*[_kind_votes(k) for k in KINDS]))
    rows = d.select(F.explode(votes).alias("x")).groupBy("x.kind", *[f"x.votes.{n}" for n in LABELERS + SHAPE]).count().collect()
    counts = {(r["kind"], tuple(r[n] for n in LABELERS + SHAPE)): r["count"] for r in rows}  # 27 x 16 rows a kind at most
    posterior, _ = estimate(counts)
    w = train(counts, posterior)
    return d.select("doc_id", *[f"base_{k}" for k in KINDS], *[_accepted(w, k).alias(f"added_{k}") for k in KINDS])


# Functions of their own, since a lambda's second parameter would be taken for the index.
def _plain(spans):
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def _holding(kind, spans):
    return F.filter(spans, lambda m: _holds(kind, m["s"]))


def _kind_votes(kind):
    return F.transform(f"loose_{kind}", lambda m: F.struct(F.lit(kind).alias("kind"), m["votes"].alias("votes")))


def _accepted(w, kind):
    return _plain(F.filter(f"loose_{kind}", lambda m: _probability(w, kind, m["votes"]) > 0.5))


def _lines(kind, spans):
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))


def op2_pii(spark, sf_dir):
    found = find(common.table(spark, sf_dir, "documents"))
    base = F.array_join(F.concat(*[_lines(k, F.col(f"base_{k}")) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[_lines(k, F.array_sort(F.concat(f"base_{k}", f"added_{k}"))) for k in KINDS]), ",")
    n = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))

"""Decisions of least expected loss from scores, prior weights and a loss matrix.

A specification names categories, gives each a prior and, for each category that is true, losses of
deciding for each category. A loss row may depend on a pattern: the first listed row whose pattern
is found in the input holds, and an empty pattern is always found. Losses are formulas of numbers, the
category's complexity, and $1 .. $9, numbers captured by the row's pattern. All arithmetic is on
logarithms, so losses can't be negative. Operators bind in the order + - * / ^, each tighter than the last.

    categories { spam, good }
    prior { 1, 2 }
    loss_matrix {
      "" spam [ 0, 1 ^ complexity ]
      "" good [ 2 ^ complexity, 0 ]
    }
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import readers

_TOKEN = re.compile(r'\s*(?:#[^\n]*\n)*\s*(?:(?P<num>[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)|(?P<name>[A-Za-z_][\w.-]*)|\$(?P<cap>[0-9])|"(?P<text>(?:[^"\\\\]|\\\\.)*)"|(?P<op>[{}\[\](),+*/^-]))')
LEVELS = ("+", "-", "*", "/", "^")


@dataclass(frozen=True)
class Row:
    pattern: str
    category: str
    losses: tuple


@dataclass(frozen=True)
class Spec:
    categories: tuple[str, ...]
    prior: tuple[float, ...]
    rows: tuple[Row, ...]


class _Reader:
    def __init__(self, text: str):
        self.items, at, text = [], 0, text.rstrip() + "\n"
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                if re.fullmatch(r"\s*(#[^\n]*\s*)*", text[at:]):
                    break
                raise ValueError(f"can't read {text[at : at + 20]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.items[self.at] if self.at < len(self.items) else (None, None)

    def take(self, kind: str, value: str | None = None) -> str:
        k, v = self.peek()
        if k != kind or value not in (None, v):
            raise ValueError(f"expected {value or kind}, found {v!r}")
        self.at += 1
        return v

    def maybe(self, op: str) -> bool:
        ok = self.peek() == ("op", op)
        self.at += ok
        return ok

    def formula(self, level: int = 0):
        if level == len(LEVELS):
            return self.atom()
        left = self.formula(level + 1)
        while self.maybe(LEVELS[level]):
            left = (LEVELS[level], left, self.formula(level + 1))
        return left

    def atom(self):
        kind, value = self.peek()
        if kind == "num":
            self.at += 1
            return ("num", float(value))
        if kind == "cap":
            self.at += 1
            return ("cap", max(1, int(value)))
        if kind == "name":
            self.at += 1
            if value == "complexity":
                return ("complexity",)
            if value in ("exp", "log"):
                self.take("op", "(")
                inner = self.formula()
                self.take("op", ")")
                return (value, inner)
            if value == "inf":
                return ("num", math.inf)
        if self.maybe("("):
            inner = self.formula()
            self.take("op", ")")
            return inner
        raise ValueError(f"no formula at {value!r}")

    def listed(self, one):
        out = [one()]
        while self.maybe(","):
            out.append(one())
        return tuple(out)


def parse(text: str) -> Spec:
    r = _Reader(text)
    r.take("name", "categories")
    r.take("op", "{")
    names = r.listed(lambda: r.take("name"))
    r.take("op", "}")
    r.take("name", "prior")
    r.take("op", "{")
    prior = r.listed(lambda: float(r.take("num")))
    r.take("op", "}")
    r.take("name", "loss_matrix")
    r.take("op", "{")
    rows = []
    while not r.maybe("}"):
        pattern = r.take("text")
        category = r.take("name")
        r.take("op", "[")
        losses = r.listed(r.formula)
        r.take("op", "]")
        rows.append(Row(pattern, category, losses))
    if len(prior) != len(names) or any(len(x.losses) != len(names) or x.category not in names for x in rows):
        raise ValueError("priors and losses must match the categories")
    return Spec(names, prior, tuple(rows))


NEVER = float("-inf")


def log_value(f, complexity: Column, captures: list[Column]) -> Column:
    """The logarithm of a formula; null where a loss would be negative."""
    op = f[0]
    if op == "num":
        return F.lit(math.log(f[1]) if f[1] > 0 else NEVER)
    if op == "complexity":
        return F.log(complexity)
    if op == "cap":
        v = captures[f[1] - 1] if f[1] <= len(captures) else F.lit(0.0)
        return F.when(v > 0, F.log(v)).when(v == 0, F.lit(NEVER))
    if op == "exp":
        return F.exp(log_value(f[1], complexity, captures))
    if op == "log":
        inner = log_value(f[1], complexity, captures)
        return F.when(inner > 0, F.log(inner)).when(inner == 0, F.lit(NEVER))
    a, b = log_value(f[1], complexity, captures), log_value(f[2], complexity, captures)
    top = F.greatest(a, b)
    if op == "+":
        return F.when(top == NEVER, F.lit(NEVER)).otherwise(top + F.log1p(F.exp(F.least(a, b) - top)))
    if op == "-":
        return F.when(a == b, F.lit(NEVER)).when(a > b, F.when(b == NEVER, a).otherwise(a + F.log1p(-F.exp(b - a))))
    if op == "*":
        return F.when((a == NEVER) | (b == NEVER), F.lit(NEVER)).otherwise(a + b)
    if op == "/":
        return F.when(a == NEVER, F.lit(NEVER)).otherwise(a - b)
    return F.when(a == NEVER, F.lit(NEVER)).otherwise(a * F.exp(b))  # ^


def decide(scores: DataFrame, spec: Spec, texts: DataFrame | None = None, key: str = "doc_id", text: str = "text", bits: bool = False) -> DataFrame:
    """(key, category, risk, log_risks): the category of least expected loss of every document.

    scores: (key, model, score, complexity) for the models named as the categories. texts is needed
    where rows have patterns. Expected losses are compared by their largest terms, then the next ones.
    bits: scores are taken in bits, as printed scores are, and no factor brings them to the losses' natural logarithms.
    """
    d, terms = _terms(scores, spec, texts, key, text, bits, False)
    cats = spec.categories
    d = d.withColumn("terms", F.transform(F.array(*[F.array(*t) for t in terms]), lambda t: F.reverse(F.array_sort(t))))
    risk = F.transform("terms", lambda t: F.when(t[0] == NEVER, F.lit(NEVER)).otherwise(t[0] + F.log(F.aggregate(t, F.lit(0.0), lambda a, v: a + F.exp(v - t[0])))))
    d = d.withColumn("log_risks", risk)
    order = F.array_min(F.transform("terms", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    names = F.array(*[F.lit(c) for c in cats])
    d = d.withColumn("at", order["i"])
    return d.select(key, F.element_at(names, F.col("at") + 1).alias("category"), F.element_at("log_risks", F.col("at") + 1).alias("risk"), "log_risks")


def decide_printed(spark, path: str, spec: Spec) -> DataFrame:
    """(line_no, category, risk, log_risks) of printed score lines. Printed scores are in bits and are taken as they are."""
    return decide(readers.score_lines(spark, path), spec, key="line_no")


def recursive(scores: DataFrame, spec: Spec, texts: DataFrame | None = None, key: str = "doc_id", text: str = "text", bits: bool = False) -> DataFrame:
    """(key, place, category, score): all categories, each the best of those that the ones before it leave.

    A category that is taken out counts neither as a decision nor as a truth. Deciding rightly costs a loss of 1
    at least, so that the last category has a score: the largest term of its expected loss.
    """
    d, terms = _terms(scores, spec, texts, key, text, bits, True)
    names = F.array(*[F.lit(c) for c in spec.categories])
    d = d.select(key, F.array(*[F.array(*t) for t in terms]).alias("terms"), F.expr("cast(array() as array<int>)").alias("gone"), F.expr("cast(array() as array<double>)").alias("found"))
    for _ in spec.categories:
        d = d.select(key, "terms", "gone", "found", _best_left().alias("x"))
        d = d.select(key, "terms", F.concat("gone", F.array("x.i")).alias("gone"), F.concat("found", F.array(F.col("x.t")[0])).alias("found"))
    return d.select(key, F.posexplode(F.arrays_zip("gone", "found")).alias("place", "x")).select(key, "place", F.element_at(names, F.col("x.gone") + 1).alias("category"), F.col("x.found").alias("score"))


def _best_left():
    """struct(t, i) of the least decision of those not in gone, by its terms in falling order."""
    left = lambda i: ~F.array_contains("gone", i)

    def one(t, i):
        own = F.reverse(F.array_sort(F.filter(t, lambda v, j: left(j))))
        return F.when(left(i), F.struct(own.alias("t"), i.alias("i")))

    return F.array_min(F.filter(F.transform("terms", one), lambda x: x.isNotNull()))


def _terms(scores: DataFrame, spec: Spec, texts: DataFrame | None, key: str, text: str, bits: bool, right_costs: bool):
    """The documents, and for each decision the log terms of its expected loss, one for each truth."""
    cats = spec.categories
    per = scores.where(F.col("model").isin(*cats)).groupBy(key).agg(*[F.max(F.when(F.col("model") == c, F.col(v))).alias(f"{v}_{k}") for k, c in enumerate(cats) for v in ("score", "complexity")])
    if texts is not None:
        per = per.join(texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("text_")), key)
    numbers = r"^\s*([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)"
    loss: list[list[Column]] = []
    for k, c in enumerate(cats):
        complexity = F.col(f"complexity_{k}")
        row = None
        for x in reversed([x for x in spec.rows if x.category == c]):
            n = min(9, re.compile(x.pattern).groups)
            captures = [F.coalesce(F.regexp_extract(F.regexp_extract("text_", x.pattern, g), numbers, 1).try_cast("double"), F.lit(0.0)) for g in range(1, n + 1)]
            values = F.array(*[log_value(f, complexity, captures) for f in x.losses])
            row = values if not x.pattern else F.when(F.col("text_").rlike(x.pattern), values).otherwise(row if row is not None else F.lit(None))
        if row is None:
            raise ValueError(f"no losses for {c}")
        loss.append(row)
    d = per
    for k, row in enumerate(loss):
        d = d.withColumn(f"loss_{k}", row)
    total = sum(spec.prior)
    unit = 1 / math.log(2) if bits else 1.0

    def term(i: int, j: int):
        if spec.prior[j] <= 0:
            return F.lit(NEVER)
        x = F.col(f"loss_{j}")[i]
        if right_costs and i == j:
            x = F.when(x == NEVER, F.lit(0.0)).otherwise(x)
        return F.when(x == NEVER, F.lit(NEVER)).otherwise(F.col(f"score_{j}") * unit + math.log(spec.prior[j] / total) + x)

    return d, [[term(i, j) for j in range(len(cats))] for i in range(len(cats))]


def disparity(scores: DataFrame, key: str = "doc_id", share: float = 0.9) -> DataFrame:
    """(key, uneven): complexities of a document's models differ by more than they should."""
    return scores.groupBy(key).agg((F.min("complexity") < share * F.max("complexity")).alias("uneven"))

"""Fitting maximum-entropy n-gram weights against a reference measure.

Orders are fitted one after the other. All features of an order with the same count, reference weight
and suffix weight keep the same weight throughout, and within a round every weight depends on log Z
alone, so a round is one sum over classes of equal features. Classes are few: they are iterated on the driver
up to CLASS_LIMIT of them, and as one aggregate a round beyond that. Weights are truncated to multiples of 1/32
in every round, which is part of what the fit means: it stops by its tolerances, not at a fixed point. No
round moves a weight by more than JUMP. As log Z moves little in a round, that is the same as keeping the weight of round k
within k * JUMP of the one it began with, so weights still follow from log Z and the round's number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written
from . import lookup, measures

# Tolerances (divergence, weight, log Z) of the quality levels.
QUALITY = {1: (0.01, 0.05, 0.05), 2: (0.01, 1 / 32, 0.05), 3: (0.01, 1 / 32, 0.01), 4: (0.01, 1 / 32, 0.01)}
ROUNDS = 50
PASSES = 50
SETTLED = 0.01
JUMP = 100.0
CLASS_LIMIT = 500_000


def with_uniform(features: DataFrame) -> DataFrame:
    return features.withColumn("dref", measures.uniform_ref(F.col("gram"), F.col("ord")))


def _cut(k: int) -> Column:
    """The last k tokens of a gram."""
    return F.array_join(F.slice(F.split("gram", " ", -1), -k, k), " ")


def _suffix_weights(current: DataFrame, fitted: DataFrame, order: int) -> DataFrame:
    """current with ltrms, the summed weights of the proper suffixes of each gram."""
    suffix = (lambda k: F.col("tails")[k - 1]) if "tails" in current.columns else _cut
    suffixes = F.array(*[F.struct(F.lit(k).alias("so"), suffix(k).alias("sg")) for k in range(1, order)])
    rows = current.select("model", "cls", "gram", F.explode(suffixes).alias("x")).select("model", "cls", "gram", "x.so", "x.sg")
    known = fitted.select("model", "cls", F.col("ord").alias("so"), F.col("gram").alias("sg"), "lam")
    sums = rows.join(known, ["model", "cls", "so", "sg"]).groupBy("model", "cls", "gram").agg(F.sum("lam").alias("ltrms"))
    return current.join(sums, ["model", "cls", "gram"], "left").withColumn("ltrms", F.coalesce("ltrms", F.lit(0.0)))


def _moved(r: int, log_z, total, k):
    """Weight of a class after round k, given log Z before it."""
    raw = (F.log("cnt") - F.log(total) - F.col("dref")) / r + log_z - F.col("ltrms")
    return F.greatest(F.least(F.greatest(raw, F.col("lam0") - JUMP * k), F.col("lam0") + JUMP * k), F.lit(0.0))


def _weight(r: int, log_z, total, k):
    return tx.truncated(_moved(r, log_z, total, k))


class _Local:
    """Sums over collected classes."""

    def __init__(self, rows, r: int, total: float):
        self.c, self.d, self.s, self.m = (np.array(x, float) for x in zip(*[(x.cnt, x.dref, x.ltrms, x.m) for x in rows], strict=True))
        self.r, self.total = r, total
        self.lam = np.array([x.lam0 for x in rows], float)
        self.first, self.k = self.lam, 0
        self.base = np.exp(np.minimum(700, r * self.s + self.d))

    def start(self) -> tuple[float, float]:
        """Of the weights to begin with: what they add to the normaliser, and their sum over tokens."""
        return float((self.m * (self.base * np.expm1(np.minimum(700, self.r * self.lam)))).sum()), float((self.m * self.lam * self.c).sum())

    def round(self, log_z: float) -> tuple[float, float, float]:
        self.k += 1
        new = (np.log(self.c) - np.log(self.total) - self.d) / self.r + log_z - self.s
        new = np.maximum(0.0, np.clip(new, self.first - JUMP * self.k, self.first + JUMP * self.k))
        change = float(np.abs(new - self.lam).max())
        self.lam = np.minimum(np.floor(new * 32), 65535) / 32
        return float((self.m * (self.base * np.expm1(np.minimum(700, self.r * self.lam)))).sum()), float((self.m * self.lam * self.c).sum()), change


class _Spread:
    """The same sums as one aggregate over a table of classes."""

    def __init__(self, classes: DataFrame, r: int, total: float):
        self.classes, self.r, self.total, self.last, self.k = classes, r, total, None, 0

    def start(self) -> tuple[float, float]:
        base = F.col("m") * F.exp(self.r * F.col("ltrms") + F.col("dref"))
        return tuple(self.classes.agg(F.sum(base * F.expm1(self.r * F.col("lam0"))), F.sum(F.col("m") * F.col("lam0") * F.col("cnt"))).first())

    def round(self, log_z: float) -> tuple[float, float, float]:
        old = _weight(self.r, F.lit(self.last), F.lit(self.total), self.k) if self.last is not None else F.col("lam0")
        self.k += 1
        raw = _moved(self.r, F.lit(log_z), F.lit(self.total), self.k)
        lam = tx.truncated(raw)
        got = self.classes.agg(F.sum(F.col("m") * F.exp(self.r * F.col("ltrms") + F.col("dref")) * F.expm1(self.r * lam)), F.sum(F.col("m") * lam * F.col("cnt")), F.max(F.abs(raw - old))).first()
        self.last = log_z
        return tuple(got)


def rounds(sums, r: int, total: float, fixed: float, quality: int) -> tuple[float, float, float, int]:
    """(log Z used by the last round, log Z, divergence, rounds) of an order; fixed: the sum that lower orders give."""
    q_div, q_lam, q_z = QUALITY[quality]
    extra, moved = sums.start()
    log_z = np.log(fixed + extra) / r
    div = -log_z + moved / total
    before = log_z
    for k in range(1, ROUNDS + 1):
        extra, moved, change = sums.round(log_z)
        before = log_z
        new = np.log(fixed + extra) / r
        new_div = -new + moved / total
        d_div, d_z = abs(new_div - div), abs(new - log_z)
        div, log_z = new_div, new
        if d_div <= q_div and change <= q_lam and d_z <= q_z:
            break
    return float(before), float(log_z), float(div), k


def fit(features: DataFrame, order: int = 1, quality: int = 1, min_count: int = 0, class_limit: int = CLASS_LIMIT, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Features (model, ord, gram, cnt, dref, ltrms, lam) and one row a model of its figures.

    features: (model, ord, gram, cnt, dref), and cls if tokens have classes (see mail.MEDIA): equal grams of
    different classes are different features. Features with counts of min_count or less get no weight.
    start: features of an earlier fit, whose weights the rounds begin with. The divergence of an order above 1 has what lower
    orders' weights add to it. Quality 4 goes over all orders again from the weights it has, until a pass leaves a model's log Z
    within one in a hundred of what it was, or PASSES have been made.
    """
    if quality != 4:
        return _pass(features, order, quality, min_count, class_limit, start)
    classed = "cls" in features.columns
    cls = (F.col("cls") if classed else F.lit(0)).cast("int").alias("cls")
    rows = features.select("model", "ord", cls, "gram", F.col("cnt").cast("long").alias("cnt"), "dref")
    on = ["model", "ord", "cls", "gram"]
    if start is not None:
        cls = (F.col("cls") if "cls" in start.columns else F.lit(0)).cast("int").alias("cls")
        rows = rows.join(start.select("model", "ord", cls, "gram", F.col("lam").alias("lam0")), on, "left")
    rows = written(rows.withColumn("lam0", F.coalesce("lam0", F.lit(0.0)) if start is not None else F.lit(0.0)))
    alike = written(_alike(rows, order))
    found, meta = _passes(alike, order, min_count, class_limit, alike.select(*on, F.col("lam0").alias("lam")) if start is not None else None)
    named = _named(rows, order)
    out = None
    for r in range(1, order + 1):  # not run unless it is asked for
        of = found.where(F.col("ord") == r).select(F.col("model").alias("model_"), F.col("cls").alias("cls_"), F.col("gram").alias("id_"), "ltrms", "lam")
        own = named[r].join(of, (F.col("model") == F.col("model_")) & F.col("cls").eqNullSafe(F.col("cls_")) & (F.col("id") == F.col("id_")))
        own = own.select("model", "ord", *(["cls"] if classed else []), "gram", "cnt", "dref", "ltrms", "lam")
        out = own if out is None else out.unionByName(own)
    return out, meta


def _tailed(rows: DataFrame, r: int, named: dict[int, DataFrame]) -> DataFrame:
    """rows (of order r, with cut_k, their last k tokens) with tails, the ids of those, and an id of their own: of all that a weight follows from."""
    for k in range(1, r):
        rows = rows.join(named[k].select("model", "cls", F.col("gram").alias(f"cut_{k}"), F.col("id").alias(f"tail_{k}")), ["model", "cls", f"cut_{k}"], "left")
    tails = [f"tail_{k}" for k in range(1, r)]
    own = F.concat_ws(",", F.col("cnt").cast("string"), F.col("dref").cast("string"), F.col("lam0").cast("string"), *[F.coalesce(t, F.lit("-")) for t in tails])
    rows = rows.withColumn("tails", F.array(*tails).cast("array<string>")).withColumn("id", own if r == 1 else F.md5(own))
    return rows.drop(*tails, *[f"cut_{k}" for k in range(1, r)])


def _named(rows: DataFrame, order: int) -> dict[int, DataFrame]:
    """By order: rows with tails and id."""
    named: dict[int, DataFrame] = {}
    for r in range(1, order + 1):
        own = rows.where(F.col("ord") == r)
        named[r] = _tailed(own.select("*", *[_cut(k).alias(f"cut_{k}") for k in range(1, r)]), r, named)
    return named


def _alike(rows: DataFrame, order: int) -> DataFrame:
    """(model, ord, cls, gram, cnt, dref, lam0, tails, m): one row for m features that keep the same weight in every pass; gram is their id."""
    named, out = _named(rows, order), None
    for r in range(1, order + 1):
        cuts = [f"cut_{k}" for k in range(1, r)]
        own = rows.where(F.col("ord") == r).select("model", "cls", "cnt", "dref", "lam0", *[_cut(k).alias(f"cut_{k}") for k in range(1, r)])
        own = own.groupBy("model", "cls", "cnt", "dref", "lam0", *cuts).agg(F.count("*").alias("m"))
        own = _tailed(own, r, named).groupBy("model", "cls", F.col("id").alias("gram"), "cnt", "dref", "lam0", "tails").agg(F.sum("m").alias("m")).withColumn("ord", F.lit(r))
        out = own if out is None else out.unionByName(own)
    return out


def _passes(features: DataFrame, order: int, min_count: int, class_limit: int, start: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Passes of quality 4 over features or, with m and tails, over what stands for m of them."""
    spark = features.sparkSession
    kept: list[DataFrame] = []
    figures: dict[str, dict] = {}
    left, before = features, {}
    for k in range(PASSES):
        found, meta = _pass(left, order, 4, min_count, class_limit, start)
        new = {x.model: x.asDict() for x in meta.collect()}  # one row a model
        for m, f in new.items():
            f["iterations"] += figures[m]["iterations"] if m in figures else 0
        figures |= new
        done = [m for m, f in new.items() if k == PASSES - 1 or f["log_z"] == before.get(m) or (f["log_z"] and abs(1 - before.get(m, 0.0) / f["log_z"]) < SETTLED)]
        kept.append(found.where(F.col("model").isin(done)))
        before = {m: f["log_z"] for m, f in new.items()}
        if len(done) == len(new):
            break
        left, start = features.where(~F.col("model").isin(done)), found
    out = kept[0]
    for d in kept[1:]:
        out = out.unionByName(d)
    return out, spark.createDataFrame([tuple(figures[m].values()) for m in sorted(figures)], META)


META = "model string, max_order int, log_z double, divergence double, iterations int, n_tokens long, n_features long"


def _pass(features: DataFrame, order: int, quality: int, min_count: int, class_limit: int, start: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One fit of every order."""
    spark = features.sparkSession
    classed = "cls" in features.columns
    cls = (F.col("cls") if classed else F.lit(0)).cast("int").alias("cls")
    m = (F.col("m") if "m" in features.columns else F.lit(1)).cast("long").alias("m")
    features = features.select("model", "ord", cls, "gram", F.col("cnt").cast("long").alias("cnt"), "dref", m, *(["tails"] if "tails" in features.columns else []))
    if start is not None:
        cls = (F.col("cls") if "cls" in start.columns else F.lit(0)).cast("int").alias("cls")
        features = features.join(start.select("model", "ord", cls, "gram", F.col("lam").alias("lam0")), ["model", "ord", "cls", "gram"], "left")
    features = written(features.withColumn("lam0", F.coalesce("lam0", F.lit(0.0)) if start is not None else F.lit(0.0)))
    done: list[DataFrame] = []
    figures: dict[str, dict] = {}
    fixed: dict[str, float] = {}
    lower: dict[str, float] = {}
    for r in range(1, order + 1):
        current = features.where(F.col("ord") == r)
        if r == 1:
            current = current.withColumn("ltrms", F.lit(0.0))
        else:
            fitted = done[0]
            for d in done[1:]:
                fitted = fitted.unionByName(d)
            current = _suffix_weights(current, fitted, r)
            weighted = fitted.where("lam > 0").groupBy("model").agg(F.sum(F.col("m") * F.exp(r * F.col("ltrms") + F.col("dref")) * F.expm1(r * F.col("lam"))).alias("x"), F.sum(F.col("m") * F.col("lam") * F.col("cnt")).alias("y"))
            found = weighted.collect()  # one row a model
            fixed, lower = {x.model: x.x for x in found}, {x.model: x.y for x in found}
        classes = current.where(F.col("cnt") > min_count).groupBy("model", "cnt", "dref", "ltrms", "lam0").agg(F.sum("m").alias("m"))
        classes = written(classes)
        sizes = classes.groupBy("model").agg(F.count("*").alias("n")).collect()
        totals = {x.model: float(x.t) for x in current.groupBy("model").agg(F.sum(F.col("cnt") * F.col("m")).alias("t")).collect()}
        local: dict[str, list] = {}
        if sum(x.n for x in sizes) <= class_limit:
            for x in classes.collect():
                local.setdefault(x.model, []).append(x)
        rows = []
        for x in sizes:
            total = totals[x.model]
            sums = _Local(local[x.model], r, total) if x.model in local else _Spread(classes.where(F.col("model") == x.model), r, total)
            before, log_z, div, k = rounds(sums, r, total, 1 + fixed.get(x.model, 0.0), quality)
            rows.append((x.model, before, total, k))
            figures[x.model] = {"log_z": log_z, "divergence": div + lower.get(x.model, 0.0) / total, "iterations": figures.get(x.model, {}).get("iterations", 0) + k, "n_tokens": int(total)}
        known = spark.createDataFrame(rows, "model string, before double, total double, rounds int")
        lam = F.when((F.col("cnt") > min_count) & F.col("before").isNotNull(), _weight(r, F.col("before"), F.col("total"), F.col("rounds"))).otherwise(0.0)
        done.append(written(current.join(F.broadcast(known), "model", "left").withColumn("lam", lam).select("model", "ord", "cls", "gram", "cnt", "dref", "ltrms", "lam", "m")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    n = {x.model: x.n for x in out.groupBy("model").agg(F.sum("m").alias("n")).collect()}
    out = out.drop("m") if classed else out.drop("m", "cls")
    meta = [(m, order, f["log_z"], f["divergence"], f["iterations"], f["n_tokens"], n.get(m, 0)) for m, f in sorted(figures.items())]
    return out, spark.createDataFrame(meta, META)


def corpus_entropy(features: DataFrame) -> DataFrame:
    """Per model: entropy in nats of its grams of the highest order."""
    top = features.groupBy("model").agg(F.max("ord").alias("ord"))
    rows = features.join(F.broadcast(top), ["model", "ord"])  # one row a model
    g = rows.groupBy("model").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.log("cnt")).alias("x"))
    return g.select("model", (F.log("n") - F.col("x") / F.col("n")).alias("shannon"))


def media_log_probabilities(features: DataFrame, meta: DataFrame, classes: int = 16) -> DataFrame:
    """Per model and medium (column cls of features): -log of its share of the model's mass."""
    r = F.col("ord")
    mass = features.groupBy("model", "cls").agg(F.sum(F.exp(r * F.col("ltrms") + F.col("dref")) * F.expm1(r * F.col("lam"))).alias("mass"))
    grid = meta.select("model", "log_z", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("cls"))
    return grid.join(mass, ["model", "cls"], "left").select("model", "cls", (-(F.log(1 / F.lit(classes) + F.coalesce("mass", F.lit(0.0))) - F.col("log_z"))).alias("log_p"))


def document_divergences(docs: DataFrame, features: DataFrame, meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """(model, key, div): -(entropy + mean weight) of documents under the model that they were learned for.

    docs: counts (model, key, ord, gram, cnt). A document's mean weight is that of its tokens, where a feature of weight 0 counts
    nothing, and one of order 1 its reference and normaliser as well.
    """
    cls = ["cls"] if "cls" in docs.columns and "cls" in features.columns else []
    weight = F.col("lam") + F.when(F.col("ord") == 1, F.col("dref") - F.col("log_z")).otherwise(0.0)
    freq = F.col("cnt") if "cnt" in features.columns else F.lit(1)
    known = features.where("lam > 0").join(F.broadcast(meta.select("model", "log_z")), "model").select("model", "ord", *cls, "gram", weight.alias("w"), freq.alias("freq"))  # a row a model
    n = F.col("cnt")
    per = lookup.summed(docs, known, ["model", "ord", *cls, "gram"], ["model", key], {"n": n, "x": n * F.coalesce("w", F.lit(0.0)), "c": n * F.log(n)})
    return per.select("model", key, (-(F.log("n") - F.col("c") / F.col("n")) - F.col("x") / F.col("n")).alias("div"))


def gamma_law(docs: DataFrame, features: DataFrame, meta: DataFrame, sample: int = 25, key: str = "doc_id") -> DataFrame:
    """Per model: mu, s2, and the shape alpha and scale beta of the gamma law of its documents' divergences.

    docs: counts (model, key, ord, gram, cnt) of the documents that a model was learned from.
    """
    return law_of(document_divergences(docs, features, meta, key), sample, key)


def law_of(per: DataFrame, sample: int = 25, key: str = "doc_id") -> DataFrame:
    """gamma_law of (model, key, div), a row a document. mu is the mean of all; s2 is the spread about mu of
    `sample` documents of each model, chosen by a hash of the key. Under two of them there is no law: all are 0 but mu.
    """
    per = written(per.select("model", key, "div"))
    mu = per.groupBy("model").agg(F.avg("div").alias("mu"))
    draw = F.row_number().over(W.partitionBy("model").orderBy(F.md5(F.col(key).cast("string")), key))
    some = per.withColumn("draw", draw).where(F.col("draw") <= sample).join(F.broadcast(mu), "model")
    spread = some.groupBy("model").agg(F.count("*").alias("k"), F.sum((F.col("div") - F.col("mu")) ** 2).alias("s"))
    got = mu.join(spread, "model").withColumn("s2", F.when(F.col("k") > 1, F.col("s") / (F.col("k") - 1)).otherwise(0.0))
    law = lambda x: F.when(F.col("s2") > 0, x).otherwise(0.0)
    return got.select("model", "mu", "s2", law(F.col("mu") ** 2 / F.col("s2")).alias("alpha"), law(F.col("s2") / F.col("mu")).alias("beta"))


def divergence_figures(docs_entropy: DataFrame) -> DataFrame:
    """Mean and unbiased variance of per-document entropies (column shannon)."""
    return docs_entropy.agg(F.count("*").alias("n_docs"), F.avg("shannon").alias("shannon"), F.var_samp("shannon").alias("shannon_s2"))

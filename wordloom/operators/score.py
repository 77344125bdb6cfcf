"""Scores of documents under several models, and what is read off them.

Feature tables of all models are folded into one row a gram with an array of weights, so a corpus is
joined once however many models there are. Counts are summed per document and gram before the join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import special
from . import features as ft
from . import lookup

LN2 = math.log(2.0)


def weights(features: DataFrame, models: list[str], on: tuple[str, ...] = ("ord", "gram"), *more: Column) -> DataFrame:
    """(ord, gram, lams): an array by the place of the model in models; null where it lacks the gram. more: further aggregates."""
    cols = [F.max(F.when(F.col("model") == m, F.col("lam"))) for m in models]
    return features.groupBy(*on).agg(F.array(*cols).alias("lams"), *more)


def score(counts: DataFrame, features: DataFrame, meta: DataFrame, ref: Column | None = None, key: str = "doc_id", by: str | None = None, own: bool = False) -> DataFrame:
    """(key, model, score, complexity, n_tokens, n_hits, s2, shannon, div) for every document and model.

    own: with own_div too, which, for models of order 1, is what fit.document_divergences gives for the model that a document was learned for.

    counts: (key, ord, gram, cnt). ref: the reference weight of an order-1 gram, uniform by default. Models
    are few: their figures go into the plan as literals. If counts and features both have cls, the class of
    a token is part of it. by: a column of all three tables (a fold, say); a document meets the models of its own value alone.
    """
    from . import measures

    found = meta.orderBy("model").collect()  # one row a model (and value of by)
    rows = list({r.model: r for r in found}.values())
    models = [r.model for r in rows]
    on = (*([by] if by else []), *(["cls"] if "cls" in counts.columns and "cls" in features.columns else []), "ord", "gram")
    ref = measures.uniform_ref(F.col("gram"), F.col("ord")) if ref is None else ref
    top = max((r.max_order for r in rows), default=1)
    freq = F.sum("cnt") if "cnt" in features.columns else F.count("*")
    n, sums = F.col("cnt"), {}
    for k, r in enumerate(rows):
        lam = F.col("lams")[k]
        known = F.col("ord") <= r.max_order
        renorm = F.lit(r.log_z / r.max_order)
        if by:
            renorm = F.element_at(F.create_map(*[F.lit(v) for q in found if q.model == r.model for v in (q[by], q.log_z / q.max_order)]), F.col(by))
        x = F.coalesce(lam, F.lit(0.0)) + F.when(F.col("ord") == 1, ref).otherwise(0.0) - renorm
        sums |= {f"score{k}": F.when(known, n * x), f"hits{k}": F.when(known & lam.isNotNull(), n), f"squares{k}": F.when(F.col("ord") == 1, n * x * x)}
        if own:
            sums[f"weight{k}"] = n * F.when(lam > 0, lam + F.when(F.col("ord") == 1, ref - renorm * r.max_order).otherwise(0.0)).otherwise(0.0)
    for o in {r.max_order for r in rows}:
        sums |= {f"tokens_{o}": F.when(F.col("ord") <= o, n), f"clogc_{o}": F.when(F.col("ord") == o, n * F.log(n)), f"top_{o}": F.when(F.col("ord") == o, n)}
    got = lookup.summed(counts.where(F.col("ord") <= top), weights(features, models, on, freq.alias("freq")), list(on), [key], sums, len(models))
    of = [
        F.struct(
            F.lit(r.model).alias("model"),
            F.col(f"score{k}").alias("score"),
            F.col(f"tokens_{r.max_order}").alias("n_tokens"),
            F.coalesce(F.col(f"hits{k}"), F.lit(0)).alias("n_hits"),
            F.col(f"squares{k}").alias("squares"),
            F.lit(r.max_order).alias("max_order"),
            F.col(f"clogc_{r.max_order}").alias("clogc"),
            *([F.col(f"weight{k}").alias("weight")] if own else []),
        )
        for k, r in enumerate(rows)
    ]
    flat = got.select(key, F.explode(F.array(*of)).alias("x")).select(key, "x.*")
    complexity = F.col("n_tokens") / F.col("max_order")
    shannon = F.log(complexity) - F.coalesce("clogc", F.lit(0.0)) / complexity
    m = F.col("n_tokens")
    s2 = F.when(m > 1, (m * F.col("squares") - F.col("score") * F.col("score")) / (m * (m - 1)))
    out = flat.withColumn("complexity", complexity).withColumn("s2", s2).withColumn("shannon", shannon)
    # of models of order 1, so that all tokens are of the highest order
    own_div = [(-(F.log("complexity") - F.coalesce("clogc", F.lit(0.0)) / F.col("complexity")) - F.col("weight") / F.col("complexity")).alias("own_div")] if own else []
    return out.select(key, "model", "score", "complexity", "n_tokens", "n_hits", "s2", "shannon", (-(F.col("score") / F.col("complexity") + F.col("shannon"))).alias("div"), *own_div)


def length_prior(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """scores with the log probability of the length under a Poisson law of each model's mean length added."""
    mean = F.col("tokens_per_doc")
    x = F.col("complexity")
    prior = -mean - 0.5 * math.log(2 * math.pi) + x * (1 + F.log(mean / x))
    return scores.join(F.broadcast(meta.select("model", "tokens_per_doc")), "model").withColumn("score", F.col("score") + prior).drop("tokens_per_doc")


def multinomial(counts: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """scores plus log of the number of orders in which the document's tokens can come: ln N! - sum of ln c!."""
    ln_factorial = lambda n: F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, k: a + F.log(k))
    m = counts.groupBy(key).agg(F.sum("cnt").alias("n"), F.sum(ln_factorial(F.col("cnt"))).alias("own"))
    m = m.select(key, (ln_factorial(F.col("n")) - F.col("own")).alias("ways"))
    return scores.join(m, key).withColumn("score", F.col("score") + F.col("ways")).drop("ways")


def best(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: the model with the highest score, the first by name among equals, and its place by name, from 1."""
    got = scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("model"))).alias("x"), F.array_sort(F.collect_set("model")).alias("names"))  # names: one a model
    return got.select(key, F.col("x.model").alias("best"), (-F.col("x.s")).alias("score"), F.array_position("names", F.col("x.model")).cast("int").alias("map_index"))


def posterior(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """scores with p, the percentage of each model given the document, models alike beforehand."""
    w = W.partitionBy(key)
    e = F.exp(F.col("score") - F.max("score").over(w))
    return scores.withColumn("e", e).withColumn("p", 100 * F.col("e") / F.sum("e").over(w)).drop("e")


def bits(scores: DataFrame) -> DataFrame:
    """scores with bits (of the whole), mean bits a token, and their deviation."""
    return scores.withColumn("bits", -F.col("score") / LN2).withColumn("bits_per_token", -F.col("score") / F.col("complexity") / LN2).withColumn("deviation", F.sqrt(F.greatest(F.col("s2"), F.lit(0.0)) / F.col("complexity")))


def hit_rate(scores: DataFrame) -> DataFrame:
    return scores.withColumn("hit_rate", 100.0 * F.col("n_hits") / F.col("n_tokens"))


def unambiguity(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: how sure its best model is, in percent, rounded up.

    Mean scores a token are taken as independent normal variables with their variances; the chance
    that each model's is best is integrated, and twice the best model's share less one is the result.
    """
    x = F.struct((-F.col("score") / F.col("complexity")).alias("mean"), F.sqrt(F.greatest(F.coalesce("s2", F.lit(0.0)), F.lit(0.0)) / F.col("complexity")).alias("sd"))
    rows = scores.groupBy(key).agg(F.array_sort(F.collect_list(x)).alias("x"))  # one element a model
    return rows.select(key, special.unambiguity_udf("x").alias("unambiguity"))


def p_value(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """scores with p_value: two-sided, in thousandths, of the divergence under each model's gamma law (alpha, beta)."""
    return scores.join(F.broadcast(meta.select("model", "alpha", "beta")), "model").withColumn("p_value", special.gamma_p_udf("div", "alpha", "beta")).drop("alpha", "beta")


def trace(grams: DataFrame, features: DataFrame, meta: DataFrame) -> DataFrame:
    """Every token of grams under every model: weight, reference, renormalisation."""
    from . import measures

    both = grams.crossJoin(F.broadcast(meta.select("model", "max_order", "log_z")))  # a row a model
    found = both.join(features.select("model", "ord", "gram", "lam"), ["model", "ord", "gram"], "left")
    ref = F.when(F.col("ord") == 1, measures.uniform_ref(F.col("gram"), F.col("ord"))).otherwise(0.0)
    return found.select(*grams.columns, "model", F.coalesce("lam", F.lit(0.0)).alias("lam"), ref.alias("ref"), (-F.col("log_z") / F.col("max_order")).alias("renorm"))


def random_model(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores under the model without features: uniform characters."""
    from . import measures

    one = counts.where("ord = 1").withColumn("x", F.col("cnt") * measures.uniform_ref(F.col("gram"), F.col("ord")))
    return one.groupBy(key).agg(F.sum("x").alias("score"), F.sum("cnt").cast("double").alias("complexity")).select(key, F.lit("random").alias("model"), "score", "complexity")


def kept_lines(line_scores: DataFrame, keep: list[str], key: list[str]) -> DataFrame:
    """Lines for which one of the kept models scores no less than every model."""
    w = W.partitionBy(*key)
    marked = line_scores.withColumn("top", F.max("score").over(w)).withColumn("kept", F.max(F.when(F.col("model").isin(*keep), F.col("score"))).over(w))
    return marked.where("kept >= top").select(*key).distinct()


def line_counts(docs: DataFrame, tokenizer: str = "alpha") -> DataFrame:
    if ft.distinct_rows(docs, "doc_id"):
        return ft.row_counts(ft.line_rows(docs), "doc_id", "line_no", tokenizer=tokenizer, text="line")
    return ft.counts(ft.token_rows(ft.line_rows(docs), tokenizer, "line"), "doc_id", "line_no")


def format_line(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """One printed line a document: models by name, each with mean bits a token and complexity."""
    part = F.format_string("%s %5.2f * %-6.1f", "model", -F.col("score") / F.col("complexity") / LN2, "complexity")
    return scores.groupBy(key).agg(F.concat_ws(" ", F.array_sort(F.collect_list(part))).alias("printed"))


def score_by_options(docs: DataFrame, groups: list, key: str = "doc_id") -> DataFrame:
    """Scores of models that were learned with different tokenizers or patterns.

    groups: (grams, features, meta) of the models that share options, where grams(docs) gives rows (key, ord, gram).
    Each group's models see the counts of their own grams.
    """
    out = None
    for grams, features, meta in groups:
        own = score(ft.counts(grams(docs), key), features, meta, key=key)
        out = own if out is None else out.unionByName(own)
    return out


def appended(docs: DataFrame, scores: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, printed): the lines of every document, each after a blank, then its printed scores."""
    lines = ft.line_rows(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))).select(key, F.col("line_no").cast("long").alias("line_no"), F.concat(F.lit(" "), "line").alias("printed"))
    last = docs.select(key, F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).cast("long").alias("line_no"))
    return lines.unionByName(last.join(format_line(scores, key), key).select(key, "line_no", "printed"))


def mean_complexity(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(model, mean_complexity, printed) of counts (model, key, ord, gram, cnt) of order 1: mean tokens of a model's documents."""
    per = docs.where("ord = 1").groupBy("model", key).agg(F.sum("cnt").alias("n")).groupBy("model").agg(F.avg("n").alias("mean_complexity"))
    return per.withColumn("printed", F.format_string("# mean_complexity %s %.1f", "model", "mean_complexity"))

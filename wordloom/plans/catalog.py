"""Registered queries and, where SQL can express them, their SQL for DuckDB.

Languages of `documents` are the categories; all queries run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import headers, mail, markup
from ..functions import text as tx
from ..operators import compare, decision, evaluate, fit, measures, score
from ..operators import features as ft
from ..session import written
from ..sources import models
from ..sources.readers import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- SQL that several oracles share -------------------------------------------------------------

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql_fold(c: str) -> str:
    return f"translate({c}, '{UP}', '{LOW}')"


def sql_tokens(c: str = "text", pattern: str = "[a-z]{1,30}") -> str:
    return f"regexp_extract_all({sql_fold(c)}, '{pattern}')"


SQL_TOKENS = f"tok as (select doc_id, lang, unnest({sql_tokens()}) as gram from documents)"
SQL_COUNTS = f"{SQL_TOKENS}, cnts as (select lang as model, gram, count(*) as cnt from tok group by all)"
SQL_TRUNC = "(case when ({x}) < 0 then -1 else 1 end) * least(floor(abs({x}) * 32), 65535) / 32.0"


def sql_fit(quality: int = 1, length: str = "strlen(gram)") -> str:
    """CTEs feat(model, gram, cnt, dref, lam) and meta(...) of the order-1 fit to cnts(model, gram, cnt), uniform measure."""
    qd, ql, qz = fit.QUALITY[quality]
    raw = lambda z, k: f"least(greatest(0.0, ln(v.c) - ln(xi) - v.d + {z}), {fit.JUMP} * ({k}))"
    lam = lambda z, k: f"(least(floor({raw(z, k)} * 32), 65535) / 32.0)"
    return f"""f as (select model, gram, cnt, ({length} + 1) * {measures.UNIFORM} as dref from cnts),
cls as (select model, cnt, dref, count(*) as m from f group by all),
arr as (select model, sum(m * cnt)::double as xi, sum(m)::bigint as n_features, list({{'c': cnt::double, 'd': dref::double, 'm': m::double}} order by cnt, dref) as a from cls group by model),
it as (
  select model, 0 as i, cast(null as double) as prior, 0.0::double as lz, 0.0::double as div, false as done from arr
  union all
  select model, i + 1, lz, new_lz, new_div, abs(new_div - div) <= {qd} and change <= {ql} and abs(new_lz - lz) <= {qz}
  from (select *, -new_lz + moved / xi as new_div from (
    select it.*, xi,
      ln(1 + list_sum(list_transform(a, lambda v: v.m * exp(v.d) * (exp({lam("lz", "i + 1")}) - 1)))) as new_lz,
      list_sum(list_transform(a, lambda v: v.m * v.c * {lam("lz", "i + 1")})) as moved,
      list_max(list_transform(a, lambda v: abs({raw("lz", "i + 1")} - (case when prior is null then 0.0 else {lam("prior", "i")} end)))) as change
    from it join arr using (model)))
  where not done and i < {fit.ROUNDS}),
last as (select model, max_by(prior, i) as prior, max_by(lz, i) as log_z, max_by(div, i) as divergence, max(i) as iterations from it group by model),
meta as (select model, log_z, divergence, iterations, xi::bigint as n_tokens, n_features from last join arr using (model)),
feat as (select f.model, gram, cnt, dref, least(floor(least(greatest(0.0, ln(cnt::double) - ln(n_tokens::double) - dref + prior), {fit.JUMP} * last.iterations) * 32), 65535) / 32.0 as lam from f join last using (model) join meta using (model))"""


SQL_SCORES = f"""{SQL_COUNTS}, {sql_fit()},
dc as (select doc_id, gram, count(*) as cnt from tok group by all),
sc as (select doc_id, m.model, sum(d.cnt * (coalesce(lam, 0) + (strlen(d.gram) + 1) * {measures.UNIFORM} - m.log_z)) as score, sum(d.cnt) as complexity,
   coalesce(sum(case when lam is not null then d.cnt end), 0) as n_hits,
   sum(d.cnt * power(coalesce(lam, 0) + (strlen(d.gram) + 1) * {measures.UNIFORM} - m.log_z, 2)) as squares,
   sum(d.cnt * ln(d.cnt)) as clogc
 from dc d cross join meta m left join feat f on f.model = m.model and f.gram = d.gram group by all),
best as (select doc_id, arg_min(model, (-score, model)) as best, max(score) as score from sc group by doc_id)"""
SQL_SCORES = SQL_SCORES.replace("arg_min(model, (-score, model))", "first(model order by score desc, model)")
REC = "with recursive "


# --- building blocks --------------------------------------------------------------------------------


def documents(spark, sf):
    return table(spark, sf, "documents")


def language_counts(spark, sf):
    d = documents(spark, sf).select(F.col("lang").alias("model"), "text")
    return ft.counts(ft.token_rows(d), "model")


def language_models(spark, sf, quality: int = 1):
    return fit.fit(fit.with_uniform(language_counts(spark, sf)), 1, quality)


def document_counts(spark, sf):
    return ft.token_counts(documents(spark, sf), "doc_id")


def language_scores(spark, sf):
    f, m = language_models(spark, sf)
    return score.score(document_counts(spark, sf), f, m)


def predictions(spark, sf):
    b = score.best(language_scores(spark, sf))
    return documents(spark, sf).select("doc_id", F.col("lang").alias("truth")).join(b, "doc_id")


# --- tokenizers ---------------------------------------------------------------------------------------


def _token_query(tokenizer, case_sensitive=False):
    def run(spark, sf):
        t = tx.tokens(F.col("text"), tokenizer, case_sensitive)
        return documents(spark, sf).select("doc_id", F.coalesce(F.size(t), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.size(F.array_distinct(t)), F.lit(0)).cast("long").alias("n_types"), F.md5(F.array_join(t, " ")).alias("digest"))

    return run


def _token_sql(c: str, pattern: str) -> str:
    t = f"regexp_extract_all({c}, '{pattern}')"
    return f"select doc_id, len({t})::bigint as n_tokens, len(list_distinct({t}))::bigint as n_types, md5(array_to_string({t}, ' ')) as digest from documents"


query("tok_alpha", _token_sql(sql_fold("text"), "[a-z]{1,30}"))(_token_query("alpha"))
query("tok_alnum", _token_sql(sql_fold("text"), "[a-z0-9]{1,30}"))(_token_query("alnum"))
query("tok_graph", _token_sql(sql_fold("text"), "[!-~]{1,30}"))(_token_query("graph"))
query("tok_char", _token_sql(sql_fold("text"), "[!-~]"))(_token_query("char"))
query("tok_case_sensitive", _token_sql("text", "[a-zA-Z]{1,30}"))(_token_query("alpha", True))
CEF2 = tx.RULES["cef2"].replace("'", "''")
query("tok_cef2", f"""with t as (select doc_id, flatten(list_transform(regexp_extract_all({sql_fold("text")}, '{CEF2}'), lambda x: regexp_extract_all(x, '(?s).{{1,30}}'))) as t from documents)
select doc_id, coalesce(len(t), 0)::bigint as n_tokens, coalesce(len(list_distinct(t)), 0)::bigint as n_types, md5(array_to_string(t, ' ')) as digest from t""")(_token_query("cef2"))
query("tok_adp")(_token_query("adp"))
query("tok_cef")(_token_query("cef"))


@query("tok_regex_overlapping", """
with m as (select doc_id, list_filter(list_transform(range(1, length(text)), lambda i: regexp_extract(substr(text, i, 2), '^[a-z2-9]{2}$')), lambda x: x <> '') as t from documents)
select doc_id, len(t)::bigint as n_matches, len(list_distinct(t))::bigint as n_types from m""")
def tok_regex_overlapping(spark, sf):
    t = tx.matches(F.col("text"), "[a-z2-9]{2}", [])
    return documents(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_matches"), F.size(F.array_distinct(t)).cast("long").alias("n_types"))


@query("tok_regex_groups", """
with m as (select doc_id, list_filter(list_transform(range(1, length(text)), lambda i: regexp_extract(substr(text, i, 3), '^([a-z])[aeiou]([a-z])$', 1) || ' ' || regexp_extract(substr(text, i, 3), '^([a-z])[aeiou]([a-z])$', 2)), lambda x: x <> ' ') as a,
 list_filter(list_transform(range(1, length(text) + 1), lambda i: regexp_extract(substr(text, i, 1), '^[0-9]$')), lambda x: x <> '') as b from documents)
select doc_id, (len(a) + len(b))::bigint as n_matches, md5(array_to_string(list_concat(a, b), ',')) as digest from m""")
def tok_regex_groups(spark, sf):
    """Two patterns, one with two groups."""
    t = tx.all_matches(F.col("text"), [("([a-z])[aeiou]([a-z])", [1, 2]), ("[0-9]", [])])
    return documents(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_matches"), F.md5(F.array_join(t, ",")).alias("digest"))


# --- counts ---------------------------------------------------------------------------------------------


@query("feature_counts", f"with {SQL_COUNTS} select model, gram, cnt from cnts")
def feature_counts(spark, sf):
    return language_counts(spark, sf).select("model", "gram", "cnt")


SQL_LINES = f"""ln as (select lang, unnest(string_split(text, chr(10))) as line from documents),
tk as (select lang, {sql_tokens("line")} as t, regexp_matches({sql_fold("line")}, '[^a-z]$') as open_ from ln),
tt as (select lang, case when len(t) > 0 and open_ then list_append(t, '') else t end as t from tk where len(t) > 0)"""


def _sql_grams(order: int, source: str) -> str:
    parts = [f"select lang, {k} as ord, unnest(list_transform(range({k}, len(t) + 1), lambda i: array_to_string(list_slice(t, i - {k - 1}, i), ' '))) as gram from {source} where len(t) >= {k}" for k in range(1, order + 1)]
    return f"gr as ({' union all '.join(parts)}) select lang as model, ord, gram, count(*) as cnt from gr where not (ord = 1 and gram = '') group by all"


@query("ngram2_counts", f"with {SQL_LINES}, {_sql_grams(2, 'tt')}")
def ngram2_counts(spark, sf):
    return ft.counts(ft.gram_rows(documents(spark, sf).select(F.col("lang").alias("model"), "text"), 2), "model")


@query("ngram3_counts", f"with {SQL_LINES}, {_sql_grams(3, 'tt')}")
def ngram3_counts(spark, sf):
    return ft.counts(ft.gram_rows(documents(spark, sf).select(F.col("lang").alias("model"), "text"), 3), "model")


@query("ngram2_straddle", f"with tt as (select lang, {sql_tokens()} as t from documents), {_sql_grams(2, 'tt')}")
def ngram2_straddle(spark, sf):
    return ft.counts(ft.gram_rows(documents(spark, sf).select(F.col("lang").alias("model"), "text"), 2, straddle=True), "model")


SQL_DIGRAMS = f"""{SQL_COUNTS},
ch as (select model, cnt, '.' || gram || '.' as g, unnest(range(1, length(gram) + 2)) as k from cnts),
dg as (select model, case when k = 1 then 1 else ascii(substr(g, k, 1)) end as i, case when k = length(g) - 1 then 1 else ascii(substr(g, k + 1, 1)) end as j, sum(cnt)::bigint as n from ch group by all)"""


@query("digram_counts", f"with {SQL_DIGRAMS} select * from dg")
def digram_counts(spark, sf):
    return ft.transitions(language_counts(spark, sf), "model")


@query("token_lengths", f"with {SQL_COUNTS} select model, strlen(gram)::int as len, sum(cnt)::bigint as n from cnts group by all")
def token_lengths(spark, sf):
    return language_counts(spark, sf).groupBy("model", F.octet_length("gram").alias("len")).agg(F.sum("cnt").alias("n"))


@query("feature_min_count", f"with {SQL_COUNTS} select model, gram, cnt from cnts where cnt > 2")
def feature_min_count(spark, sf):
    return ft.min_count(language_counts(spark, sf), 2).select("model", "gram", "cnt")


@query("feature_topk", f"with {SQL_COUNTS} select model, gram, cnt from (select *, row_number() over (partition by model order by cnt desc, gram) as r from cnts) where r <= 20")
def feature_topk(spark, sf):
    r = F.row_number().over(W.partitionBy("model").orderBy(F.desc("cnt"), "gram"))
    return language_counts(spark, sf).withColumn("r", r).where("r <= 20").select("model", "gram", "cnt")


@query("merge_learners", f"with {SQL_COUNTS} select model, gram, cnt from cnts")
def merge_learners(spark, sf):
    """Learners of even and odd lengths, merged: the counts of learning all."""
    d = documents(spark, sf).select(F.col("lang").alias("model"), "text", "n_chars")
    parts = [ft.counts(ft.token_rows(d.where(F.coalesce(F.col("n_chars"), F.lit(0)) % 2 == k).drop("n_chars")), "model") for k in (0, 1)]
    return ft.merge(*parts).select("model", "gram", "cnt")


@query("decimate", "select doc_id, n_chars from documents where ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 4 = 0")
def decimate(spark, sf):
    return ft.decimate(documents(spark, sf), 2).select("doc_id", "n_chars")


@query("reservoir", "select doc_id from documents order by md5(doc_id::varchar), doc_id limit 25")
def reservoir(spark, sf):
    return ft.reservoir(documents(spark, sf)).select("doc_id")


SQL_DOC_ENTROPY = f"""{SQL_TOKENS}, dc as (select doc_id, gram, count(*) as cnt from tok group by all),
de as (select doc_id, sum(cnt)::bigint as tokens, count(*) as types, ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt) as shannon from dc group by doc_id)"""


@query("doc_entropy", f"with {SQL_DOC_ENTROPY} select doc_id, tokens, types, round(shannon, 6) as shannon from de")
def doc_entropy(spark, sf):
    return ft.doc_entropy(documents(spark, sf)).withColumn("shannon", F.round("shannon", 6))


@query("entropy_mean_variance", f"with {SQL_DOC_ENTROPY} select count(*) as n_docs, round(avg(shannon), 6) as shannon, round(var_samp(shannon), 6) as shannon_s2 from de")
def entropy_mean_variance(spark, sf):
    g = fit.divergence_figures(ft.doc_entropy(documents(spark, sf)))
    return g.select("n_docs", F.round("shannon", 6).alias("shannon"), F.round("shannon_s2", 6).alias("shannon_s2"))


@query("corpus_entropy", f"with {SQL_COUNTS} select model, round(ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt), 6) as shannon from cnts group by model")
def corpus_entropy(spark, sf):
    return fit.corpus_entropy(language_counts(spark, sf)).withColumn("shannon", F.round("shannon", 6))


# --- reference measures ---------------------------------------------------------------------------------


@query("ref_uniform", f"with {SQL_COUNTS} select distinct gram, (strlen(gram) + 1) * {measures.UNIFORM}::double as w from cnts")
def ref_uniform(spark, sf):
    return language_counts(spark, sf).select("gram").distinct().select("gram", measures.uniform_ref(F.col("gram"), F.lit(1)).alias("w"))


SQL_ALL_DIGRAMS = f"{SQL_DIGRAMS}, ad as (select i, j, sum(n) as n from dg group by all)"


def _all_digrams(spark, sf):
    return ft.transitions(language_counts(spark, sf), "model").groupBy("i", "j").agg(F.sum("n").alias("n"))


@query("ref_mle", f"""with {SQL_ALL_DIGRAMS}, e as (select *, 253 - count(*) over (partition by i) as m, n / sum(n) over (partition by i) as fr from ad),
p as (select i, j, ln(case when m > 0 then fr * (1 - 1.0::double / m) + 1.0::double / m else fr end) as x from e) select i, j, ({SQL_TRUNC.format(x="x")})::double as w from p""")
def ref_mle(spark, sf):
    return measures.mle(_all_digrams(spark, sf))


@query("ref_iid", f"""with {SQL_ALL_DIGRAMS}, c as (select j, sum(n) as n from ad group by j), e as (select *, 253 - count(*) over () as m, n / sum(n) over () as fr from c),
p as (select j, ln(case when m > 0 then fr * (1 - 1.0::double / m) + 1.0::double / m else fr end) as x from e) select j, ({SQL_TRUNC.format(x="x")})::double as w from p""")
def ref_iid(spark, sf):
    return measures.iid(_all_digrams(spark, sf))


@query("ref_toklen", f"""with {SQL_COUNTS}, l as (select strlen(gram) as len, sum(cnt) as n from cnts group by all), g as (select r as len, coalesce(n, 1) as n from range(1, 31) t(r) left join l on l.len = r),
p as (select len, ln(n / sum(n) over ()) - len * ln(253) as x from g) select len::int as len, ({SQL_TRUNC.format(x="x")})::double as w from p""")
def ref_toklen(spark, sf):
    return measures.toklen(language_counts(spark, sf))


@query("ref_dirichlet")
def ref_dirichlet(spark, sf):
    n = measures.matrix(_all_digrams(spark, sf))
    return measures.cells(spark, measures.dirichlet(n), n)


@query("ref_maxent")
def ref_maxent(spark, sf):
    n = measures.matrix(_all_digrams(spark, sf))
    return measures.cells(spark, measures.maxent(n), n)


# --- models and scores ----------------------------------------------------------------------------------


@query("model_fit", f"{REC}{SQL_COUNTS}, {sql_fit()} select model, iterations::int as iterations, round(log_z, 4) as log_z, round(divergence, 4) as divergence, n_tokens, n_features from meta")
def model_fit(spark, sf):
    _, m = language_models(spark, sf)
    return m.select("model", "iterations", F.round("log_z", 4).alias("log_z"), F.round("divergence", 4).alias("divergence"), "n_tokens", F.col("n_features").cast("long").alias("n_features"))


@query("model_features", f"{REC}{SQL_COUNTS}, {sql_fit()} select model, gram, cnt, dref::double as dref, lam::double as lam from feat")
def model_features(spark, sf):
    f, _ = language_models(spark, sf)
    return f.select("model", "gram", "cnt", "dref", "lam")


@query("model_fit_quality3", f"{REC}{SQL_COUNTS}, {sql_fit(3)} select model, iterations::int as iterations, round(log_z, 4) as log_z from meta")
def model_fit_quality3(spark, sf):
    _, m = language_models(spark, sf, 3)
    return m.select("model", "iterations", F.round("log_z", 4).alias("log_z"))


@query("model_fit_bigram")
def model_fit_bigram(spark, sf):
    d = documents(spark, sf).select(F.col("lang").alias("model"), "text")
    f, m = fit.fit(fit.with_uniform(ft.counts(ft.gram_rows(d, 2), "model")), 2)
    return m.select("model", "max_order", "iterations", F.round("log_z", 4).alias("log_z"), F.round("divergence", 4).alias("divergence"))


@query("model_fit_quality4")
def model_fit_quality4(spark, sf):
    """Bigram models in several passes over the orders."""
    d = documents(spark, sf).select(F.col("lang").alias("model"), "text")
    _, m = fit.fit(fit.with_uniform(ft.counts(ft.gram_rows(d, 2), "model")), 2, 4)
    return m.select("model", "max_order", "iterations", F.round("log_z", 4).alias("log_z"), F.round("divergence", 4).alias("divergence"))


SQL_FORCED = f"{SQL_LINES}, {_sql_grams(2, 'tt').replace('lang as model, ord,', 'lang as model, 1 as ord,')}"


@query("forced_order_counts", f"with {SQL_FORCED}")
def forced_order_counts(spark, sf):
    return ft.counts(ft.forced(ft.gram_rows(documents(spark, sf).select(F.col("lang").alias("model"), "text"), 2)), "model")


SQL_TOP = f"{SQL_LINES}, cnts as ({_sql_grams(2, 'tt').replace('gr as', 'select model, gram, cnt from (with gr as', 1)}) where ord = 2)"


@query("unigram_fallback", f"{REC}{SQL_TOP}, {sql_fit()} select model, iterations::int as iterations, round(log_z, 4) as log_z, n_tokens, n_features from meta")
def unigram_fallback(spark, sf):
    """Models whose only grams are of order 2, which are then fitted as features of order 1."""
    d = documents(spark, sf).select(F.col("lang").alias("model"), "text")
    top = ft.counts(ft.gram_rows(d, 2, least=2), "model")
    _, m = fit.fit(fit.with_uniform(ft.or_forced(top, "model")))
    return m.select("model", "iterations", F.round("log_z", 4).alias("log_z"), "n_tokens", F.col("n_features").cast("long").alias("n_features"))


@query("model_integrity", f"""{REC}{SQL_COUNTS}, {sql_fit()} select model, min(lam) >= 0 as weights_ok, count(*) = any_value(n_features) as count_ok, count(*) = count(distinct gram) as distinct_ok
from feat join meta using (model) group by model""")
def model_integrity(spark, sf):
    return evaluate.integrity(*language_models(spark, sf))


ROLES = {"user": 1, "assistant": 2, "system": 3}
SQL_CLASSES = f"""tok as (select case role {" ".join(f"when '{r}' then {k}" for r, k in ROLES.items())} else 0 end as cls, unnest({sql_tokens()}) as gram from conversations),
cnts as (select 'all' as model, cls || '|' || gram as gram, count(*) as cnt from tok group by all), {sql_fit(length="strlen(gram) - 2")}"""


def class_models(spark, sf):
    """A model in which a token's class is the role of who said it."""
    cls = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for x in ROLES.items() for v in x]), F.col("role")), F.lit(0))
    d = table(spark, sf, "conversations").select(F.lit("all").alias("model"), cls.alias("cls"), "text")
    return fit.fit(fit.with_uniform(ft.counts(ft.token_rows(d), "model")), 1)


@query("class_model_features", f"{REC}{SQL_CLASSES} select model, substr(gram, 1, 1)::int as cls, substr(gram, 3) as gram, cnt, lam::double as lam from feat")
def class_model_features(spark, sf):
    return class_models(spark, sf)[0].select("model", "cls", "gram", "cnt", "lam")


@query("class_log_probabilities", f"""{REC}{SQL_CLASSES}, mass as (select substr(gram, 1, 1)::int as cls, sum(exp(dref) * (exp(lam) - 1)) as x from feat group by all)
select model, k::int as cls, round(-(ln(1.0 / 16 + coalesce(x, 0)) - log_z), 4) as log_p from meta cross join range(0, 16) t(k) left join mass on mass.cls = k""")
def class_log_probabilities(spark, sf):
    return fit.media_log_probabilities(*class_models(spark, sf)).select("model", "cls", F.round("log_p", 4).alias("log_p"))


def language_document_counts(spark, sf):
    return ft.token_counts(documents(spark, sf).select(F.col("lang").alias("model"), "doc_id", "text"), "model", "doc_id")


@query("gamma_law", f"""{REC}{SQL_COUNTS}, {sql_fit()}, dcl as (select lang as model, doc_id, gram, count(*) as cnt from tok group by all),
w as (select model, gram, lam + dref - log_z as w from feat join meta using (model) where lam > 0),
dv as (select model, doc_id, -(ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt)) - sum(cnt * coalesce(w, 0)) / sum(cnt) as div from dcl left join w using (model, gram) group by model, doc_id),
mu as (select model, avg(div) as mu from dv group by model), pick as (select *, row_number() over (partition by model order by md5(doc_id::varchar), doc_id) as r from dv),
sp as (select model, any_value(mu) as mu, sum(power(div - mu, 2)) / (count(*) - 1) as s2 from pick join mu using (model) where r <= 25 group by model)
select model, round(mu, 4) as mu, round(s2, 4) as s2, round(mu * mu / s2, 2) as alpha, round(s2 / mu, 5) as beta from sp""")
def gamma_law(spark, sf):
    g = fit.gamma_law(language_document_counts(spark, sf), *language_models(spark, sf))
    return g.select("model", F.round("mu", 4).alias("mu"), F.round("s2", 4).alias("s2"), F.round("alpha", 2).alias("alpha"), F.round("beta", 5).alias("beta"))


@query("score_p_values")
def score_p_values(spark, sf):
    f, m = language_models(spark, sf)
    d = documents(spark, sf).select("doc_id", F.col("lang").alias("model"))
    if not ft.distinct_rows(d, "doc_id"):  # a document of several languages has a divergence for each
        law = fit.gamma_law(language_document_counts(spark, sf), f, m)
        return score.p_value(score.score(document_counts(spark, sf), f, m), law).select("doc_id", "model", "p_value")
    s = written(score.score(document_counts(spark, sf), f, m, own=True).select("doc_id", "model", "div", "own_div"))
    law = fit.law_of(s.join(d, ["doc_id", "model"]).select("model", "doc_id", F.col("own_div").alias("div")))
    return score.p_value(s.drop("own_div"), law).select("doc_id", "model", "p_value")


@query("mean_complexity", f"with {SQL_TOKENS} select lang as model, round(count(*)::double / count(distinct doc_id), 6) as mean_complexity from tok group by lang")
def mean_complexity(spark, sf):
    return score.mean_complexity(language_document_counts(spark, sf)).select("model", F.round("mean_complexity", 6).alias("mean_complexity"))


@query("append_echo", f"""with {SQL_TOKENS}, a as (select doc_id, line_no::bigint as line_no, ' ' || line as line from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as line_no from documents)),
s as (select distinct doc_id, len(string_split(coalesce(text, ''), chr(10)))::bigint as line_no from documents semi join tok using (doc_id))
select doc_id, line_no, md5(line) as digest, false as is_score from a union all select doc_id, line_no, null, true from s""")
def append_echo(spark, sf):
    """Every document's lines, and behind them its scores in print."""
    a = score.appended(documents(spark, sf), language_scores(spark, sf))
    is_score = F.col("printed").rlike(r"^de +[0-9.-]+ \* [0-9.]+ +en ")
    return a.select("doc_id", "line_no", F.when(~is_score, F.md5("printed")).alias("digest"), is_score.alias("is_score"))


@query("model_dump_read", f"with {SQL_COUNTS} select model, gram, cnt, 1 as ord from cnts")
def model_dump_read(spark, sf):
    """Features printed and read back."""
    return models.read_dump(models.dump(language_models(spark, sf)[0])).select("model", "gram", "cnt", "ord")


@query("model_reference_only", f"with {SQL_TOKENS} select doc_id, sum((strlen(gram) + 1) * {measures.UNIFORM})::double as score, count(*)::double as complexity from tok group by doc_id")
def model_reference_only(spark, sf):
    return score.random_model(document_counts(spark, sf)).select("doc_id", "score", "complexity")


@query("document_scores", f"""{REC}{SQL_SCORES} select doc_id, model, round(score, 4) as score, complexity::double as complexity, n_hits::bigint as n_hits,
round(ln(complexity) - clogc / complexity, 6) as shannon, round(-(score / complexity + ln(complexity) - clogc / complexity), 4) as div from sc""")
def document_scores(spark, sf):
    s = language_scores(spark, sf)
    return s.select("doc_id", "model", F.round("score", 4).alias("score"), "complexity", "n_hits", F.round("shannon", 6).alias("shannon"), F.round("div", 4).alias("div"))


@query("classify_languages", f"{REC}{SQL_SCORES} select doc_id, lang as truth, best, round(score, 4) as score from documents join best using (doc_id)")
def classify_languages(spark, sf):
    return predictions(spark, sf).select("doc_id", "truth", "best", F.round("score", 4).alias("score"))


@query("posterior", f"""{REC}{SQL_SCORES}, e as (select doc_id, model, exp(score - max(score) over (partition by doc_id)) as e from sc)
select doc_id, model, round(100 * e / sum(e) over (partition by doc_id), 4) as p from e""")
def posterior(spark, sf):
    return score.posterior(language_scores(spark, sf)).select("doc_id", "model", F.round("p", 4).alias("p"))


@query("score_bits", f"{REC}{SQL_SCORES} select doc_id, model, round(-score / ln(2), 4) as bits, round(-score / complexity / ln(2), 5) as bits_per_token from sc")
def score_bits(spark, sf):
    s = score.bits(language_scores(spark, sf))
    return s.select("doc_id", "model", F.round("bits", 4).alias("bits"), F.round("bits_per_token", 5).alias("bits_per_token"))


@query("score_variance", f"{REC}{SQL_SCORES} select doc_id, model, round((complexity * squares - score * score) / (complexity * (complexity - 1)), 4) as s2 from sc where complexity > 1")
def score_variance(spark, sf):
    return language_scores(spark, sf).where("n_tokens > 1").select("doc_id", "model", F.round("s2", 4).alias("s2"))


@query("hit_rate", f"{REC}{SQL_SCORES} select doc_id, model, round(100.0 * n_hits / complexity, 4) as hit_rate from sc")
def hit_rate(spark, sf):
    return score.hit_rate(language_scores(spark, sf)).select("doc_id", "model", F.round("hit_rate", 4).alias("hit_rate"))


SQL_LENGTH = "ml as (select lang as model, count(*)::double / count(distinct doc_id) as l from tok group by lang)"


@query("length_prior", f"{REC}{SQL_SCORES}, {SQL_LENGTH} select doc_id, model, round(score - l - 0.5 * ln(2 * pi()) + complexity * (1 + ln(l / complexity)), 4) as score from sc join ml using (model)")
def length_prior(spark, sf):
    f, m = language_models(spark, sf)
    d = language_document_counts(spark, sf)
    per = d.groupBy("model", "doc_id").agg(F.sum("cnt").alias("n")).groupBy("model").agg(F.avg("n").alias("tokens_per_doc"))
    s = score.length_prior(score.score(document_counts(spark, sf), f, m), m.join(per, "model"))
    return s.select("doc_id", "model", F.round("score", 4).alias("score"))


@query("multinomial_ways", f"""with {SQL_TOKENS}, dc as (select doc_id, gram, count(*) as cnt from tok group by all), n as (select doc_id, sum(cnt) as n, sum(lgamma(cnt + 1)) as own from dc group by doc_id)
select doc_id, round(lgamma(n + 1) - own, 3) as ways from n""")
def multinomial_ways(spark, sf):
    c = document_counts(spark, sf)
    zero = c.select("doc_id").distinct().withColumn("score", F.lit(0.0))
    return score.multinomial(c, zero).select("doc_id", F.round("score", 3).alias("ways"))


@query("unambiguity")
def unambiguity(spark, sf):
    return score.unambiguity(language_scores(spark, sf))


@query("token_trace", f"{REC}{SQL_COUNTS}, {sql_fit()}, g as (select distinct gram from cnts) select g.gram, m.model, coalesce(lam, 0)::double as lam, ((strlen(g.gram) + 1) * {measures.UNIFORM})::double as ref, round(-log_z, 4) as renorm from g cross join meta m left join feat f on f.model = m.model and f.gram = g.gram")
def token_trace(spark, sf):
    f, m = language_models(spark, sf)
    g = f.select("ord", "gram").distinct()
    return score.trace(g, f, m).select("gram", "model", "lam", "ref", F.round("renorm", 4).alias("renorm"))


SQL_LINE_SCORES = f"""{SQL_COUNTS}, {sql_fit()},
ll as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line from documents),
lt as (select doc_id, line_no, unnest({sql_tokens("line")}) as gram from ll),
lc as (select doc_id, line_no, gram, count(*) as cnt from lt group by all),
lsc as (select doc_id, line_no, m.model, sum(d.cnt * (coalesce(lam, 0) + (strlen(d.gram) + 1) * {measures.UNIFORM} - m.log_z)) as score from lc d cross join meta m left join feat f on f.model = m.model and f.gram = d.gram group by all)"""


def _line_scores(spark, sf):
    f, m = language_models(spark, sf)
    c = score.line_counts(documents(spark, sf).select("doc_id", "text")).withColumn("key", F.struct("doc_id", "line_no"))
    s = score.score(c.select("key", "ord", "gram", "cnt"), f, m, key="key")
    return s.select("key.doc_id", "key.line_no", "model", "score")


@query("line_scores", f"{REC}{SQL_LINE_SCORES} select doc_id, line_no::int as line_no, model, round(score, 4) as score from lsc")
def line_scores(spark, sf):
    return _line_scores(spark, sf).withColumn("score", F.round("score", 4))


@query("line_filter", f"{REC}{SQL_LINE_SCORES} select doc_id, line_no::int as line_no from lsc group by all having max(case when model = 'en' then score end) >= max(score)")
def line_filter(spark, sf):
    return score.kept_lines(_line_scores(spark, sf), ["en"], ["doc_id", "line_no"])


@query("media_counts", f"with t as (select conv_id, role, unnest({sql_tokens()}) as gram from conversations) select conv_id, coalesce(role, '') as medium, count(*) as n, count(distinct gram) as types from t group by all")
def media_counts(spark, sf):
    c = ft.counts(ft.token_rows(table(spark, sf, "conversations").select("conv_id", F.coalesce("role", F.lit("")).alias("medium"), "text")), "conv_id", "medium")
    return c.groupBy("conv_id", "medium").agg(F.sum("cnt").alias("n"), F.count("*").alias("types"))


# --- comparison, decision, ranking, evaluation ------------------------------------------------------------

SQL_PAIRS = f"""{SQL_COUNTS}, {sql_fit()},
mm as (select a.model as model_a, b.model as model_b, a.log_z as z_a, b.log_z as z_b from meta a join meta b on a.model < b.model),
gg as (select distinct gram, dref from feat),
pr as (select mm.*, gg.dref, coalesce(fa.lam, 0) as la, coalesce(fb.lam, 0) as lb from mm cross join gg left join feat fa on fa.model = model_a and fa.gram = gg.gram left join feat fb on fb.model = model_b and fb.gram = gg.gram)"""


@query("kl_divergence", f"""{REC}{SQL_PAIRS} select model_a, model_b, round((z_b - z_a + sum((la - lb) * exp(la + dref - z_a))) / ln(2), 4) as d_ab,
round((z_a - z_b + sum((lb - la) * exp(lb + dref - z_b))) / ln(2), 4) as d_ba from pr group by model_a, model_b, z_a, z_b""")
def kl_divergence(spark, sf):
    k = compare.kl(*language_models(spark, sf))
    return k.select("model_a", "model_b", F.round("d_ab", 4).alias("d_ab"), F.round("d_ba", 4).alias("d_ba"))


SQL_SWEEP = f"""{SQL_PAIRS}, bb as (select *, k / 10.0::double as beta from pr cross join range(0, 11) t(k)),
bl as (select *, beta * la + (1 - beta) * lb as lm from bb),
sw as (select model_a, model_b, z_a, z_b, beta, ln(1 + sum((exp(lm) - 1) * exp(dref))) as z, sum((lm - la) * exp(lm + dref)) as xa, sum((lm - lb) * exp(lm + dref)) as xb from bl group by all),
sweep as (select model_a, model_b, beta, (z_a - z + xa * exp(-z)) / ln(2) as d_a, (z_b - z + xb * exp(-z)) / ln(2) as d_b, (beta * z_a + (1 - beta) * z_b - z) / ln(2) as psi from sw)"""


@query("chernoff_sweep", f"{REC}{SQL_SWEEP} select model_a, model_b, beta, round(d_a, 4) + 0.0 as d_a, round(d_b, 4) + 0.0 as d_b, round(psi, 4) + 0.0 as psi from sweep")
def chernoff_sweep(spark, sf):
    s = compare.sweep(*language_models(spark, sf))
    plain = lambda c: (F.round(c, 4) + 0.0).alias(c)  # noqa: E731  no negative zero
    return s.select("model_a", "model_b", "beta", plain("d_a"), plain("d_b"), plain("psi"))


@query("chernoff_point", f"""{REC}{SQL_SWEEP}, lagged as (select *, lag(beta) over w as b0, lag((d_a + d_b) / 2) over w as d0 from sweep window w as (partition by model_a, model_b order by beta)),
fst as (select *, row_number() over (partition by model_a, model_b order by beta) as r from lagged where d_a <= d_b)
select model_a, model_b, round(case when b0 is null then beta else (b0 + beta) / 2 end, 4) as beta, round(case when d0 is null then (d_a + d_b) / 2 else (d0 + (d_a + d_b) / 2) / 2 end, 4) as information from fst where r = 1""")
def chernoff_point(spark, sf):
    c = compare.chernoff(compare.sweep(*language_models(spark, sf)))
    return c.select("model_a", "model_b", F.round("beta", 4).alias("beta"), F.round("information", 4).alias("information"))


RISK = """
categories { en, de, fr, es }
prior { 4, 2, 1, 1 }
loss_matrix {
  "" en [ 0, 2, 2, 2 ]
  "" de [ 1, 0, 1, 1 ]
  "" fr [ 1, 1, 0, complexity ]
  "" es [ 1, 1, 3, 0 ]
}
"""


@query("risk_decision", f"""{REC}{SQL_SCORES}, w as (select doc_id, max(case when model = 'en' then score end) as en, max(case when model = 'de' then score end) as de, max(case when model = 'fr' then score end) as fr, max(case when model = 'es' then score end) as es, max(complexity) as c from sc group by doc_id),
t as (select doc_id, en + ln(4.0 / 8) as en, de + ln(2.0 / 8) as de, fr + ln(1.0 / 8) as fr, es + ln(1.0 / 8) as es, ln(c::double) as lc from w),
v as (select doc_id, unnest([{{'category': 'en', 'k': 1, 't': [de, fr, es, '-inf'::double]}}, {{'category': 'de', 'k': 2, 't': [en + ln(2), fr, es, '-inf'::double]}}, {{'category': 'fr', 'k': 3, 't': [en + ln(2), de, es + ln(3), '-inf'::double]}}, {{'category': 'es', 'k': 4, 't': [en + ln(2), de, fr + lc, '-inf'::double]}}], recursive := true) from t),
s as (select doc_id, category, k, list_reverse_sort(t) as t from v)
select doc_id, first(category order by t, k) as category from s group by doc_id""")
def risk_decision(spark, sf):
    return decision.decide(language_scores(spark, sf), decision.parse(RISK)).select("doc_id", "category")


RISK_PATTERNS = """
categories { en, de }
prior { 1, 1 }
loss_matrix {
  "(?i)license ([0-9]+)" en [ 0, $1 + 1 ]
  "" en [ 0, 1 ]
  "" de [ 2 ^ complexity, 0 ]
}
"""


@query("risk_patterns", f"""{REC}{SQL_SCORES}, w as (select doc_id, max(case when model = 'en' then score end) as en, max(case when model = 'de' then score end) as de, max(complexity) as c from sc group by doc_id),
t as (select doc_id, de + c * ln(2) as r_en, en + case when regexp_matches(coalesce(text, ''), 'license [0-9]+', 'i') then ln(try_cast(regexp_extract(text, 'license ([0-9]+)', 1, 'i') as double) + 1) else 0 end as r_de from w join documents using (doc_id))
select doc_id, case when r_en <= r_de then 'en' else 'de' end as category from t""")
def risk_patterns(spark, sf):
    return decision.decide(language_scores(spark, sf), decision.parse(RISK_PATTERNS), documents(spark, sf)).select("doc_id", "category")


@query("recursive_decision")
def recursive_decision(spark, sf):
    """All categories in the order in which they are best of those left."""
    r = decision.recursive(language_scores(spark, sf), decision.parse(RISK))
    return r.select("doc_id", "place", "category", F.round("score", 4).alias("score"))


@query("ranked_documents", f"{REC}{SQL_SCORES} select doc_id, round(-score / complexity, 4) as s1 from sc where model = 'en' order by -score / complexity, doc_id limit 100")
def ranked_documents(spark, sf):
    s = evaluate.rank_scores(language_scores(spark, sf).where("model = 'en'"))
    return evaluate.ranked(s, "s1", k=100).select("doc_id", F.round("s1", 4).alias("s1"))


@query("pattern_marks", "select doc_id, case when regexp_matches(text, 'copyright', 'i') then false when regexp_matches(text, 'license', 'i') then true else false end as limited from documents")
def pattern_marks(spark, sf):
    return evaluate.marked(documents(spark, sf), [(True, "license"), (False, "copyright")]).select("doc_id", F.coalesce("limited", F.lit(False)).alias("limited"))


@query("confusion", f"""{REC}{SQL_SCORES}, p as (select lang as truth, best as predicted, count(*) as n from documents join best using (doc_id) group by all)
select truth, predicted, n, round(100.0 * n / sum(n) over (partition by truth), 4) as recall, round(100.0 * n / sum(n) over (partition by predicted), 4) as precision from p""")
def confusion(spark, sf):
    c = evaluate.confusion(predictions(spark, sf))
    return c.select("truth", "predicted", "n", F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision"))


@query("cumulative_errors", f"{REC}{SQL_SCORES} select doc_id, count(*) over w as n, (sum((lang is distinct from best)::int) over w)::bigint as errors from documents join best using (doc_id) window w as (order by doc_id rows unbounded preceding)")
def cumulative_errors(spark, sf):
    return evaluate.cumulative_errors(predictions(spark, sf), "doc_id")


@query("biplot", f"{REC}{SQL_SCORES}, b as (select doc_id, max(case when model = 'en' then -score / complexity end) as a, max(case when model = 'de' then -score / complexity end) as b from sc group by doc_id) select doc_id, round(a, 4) as a, round(b, 4) as b, round(b - a, 4) as difference from b")
def biplot(spark, sf):
    b = evaluate.biplot(language_scores(spark, sf), "en", "de")
    return b.select("doc_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("difference", 4).alias("difference"))


FOLDS = 5
SQL_FOLD = f"(('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % {FOLDS})"


def cross_validated(spark, sf):
    """Every document under the models learned from the other folds: (doc_id, truth, best)."""
    d = documents(spark, sf).select("doc_id", "lang", "text").withColumn("fold", evaluate.fold_of("doc_id", FOLDS))
    c = ft.counts(ft.token_rows(d.select(F.col("lang").alias("model"), "fold", "text")), "model", "fold")
    train = evaluate.training_sets(c, FOLDS).withColumn("model", F.concat("model", F.lit("/"), F.col("fold").cast("string"))).drop("fold")
    apart = lambda t: t.withColumn("fold", F.split("model", "/")[1].cast("int")).withColumn("model", F.split("model", "/")[0])
    f, m = map(apart, fit.fit(fit.with_uniform(train), 1))
    own = score.score(ft.token_counts(d, "doc_id", "fold"), f, m, by="fold")
    return d.select("doc_id", F.col("lang").alias("truth")).join(score.best(own), "doc_id")


@query("cross_validation", f"""{REC}{SQL_TOKENS}, tf as (select doc_id, lang, gram, {SQL_FOLD} as fold from tok), fc as (select lang, fold, gram, count(*) as cnt from tf group by all),
cnts as (select lang || '/' || k as model, gram, sum(cnt) as cnt from fc cross join range(0, {FOLDS}) t(k) where fold <> k group by all), {sql_fit()},
dc as (select doc_id, fold, gram, count(*) as cnt from tf group by all),
sc as (select doc_id, m.model, sum(d.cnt * (coalesce(lam, 0) + (strlen(d.gram) + 1) * {measures.UNIFORM} - m.log_z)) as score from dc d join meta m on split_part(m.model, '/', 2) = d.fold::varchar left join feat f on f.model = m.model and f.gram = d.gram group by all),
best as (select doc_id, split_part(first(model order by score desc, model), '/', 1) as best from sc group by doc_id),
p as (select lang as truth, best as predicted, count(*) as n from documents join best using (doc_id) group by all) select * from p""")
def cross_validation(spark, sf):
    return evaluate.confusion(cross_validated(spark, sf)).select("truth", "predicted", "n")


# --- formats --------------------------------------------------------------------------------------------


@query("strip_tags", "select page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) as digest from pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(markup.strip_tags(F.col("html"))).alias("digest"))


@query("page_links", "select page_id, len(regexp_extract_all(html, '(?i)\\b(?:href|src)=\"([^\"]*)\"', 1))::bigint as n, md5(array_to_string(regexp_extract_all(html, '(?i)\\b(?:href|src)=\"([^\"]*)\"', 1), ' ')) as digest from pages")
def page_links(spark, sf):
    x = markup.links(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(x).cast("long").alias("n"), F.md5(F.array_join(x, " ")).alias("digest"))


def _page_query(show):
    def run(spark, sf):
        t = markup.clean_udf(show)("html")
        return table(spark, sf, "pages").select("page_id", t.alias("visible"))

    return run


query("page_text")(_page_query(()))
query("page_text_all")(_page_query(markup.OPTIONS))


@query("printable_runs", "select page_id, len(regexp_extract_all(html, '[ -~]{4,}'))::bigint as n from pages")
def printable_runs(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(tx.printable_runs(F.col("html"))).cast("long").alias("n"))


@query("indented_lines", "select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x[1] = ' '))::bigint as n from documents")
def indented_lines(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(tx.indented(tx.lines(F.col("text")))).cast("long").alias("n"))


def messages(spark, sf):
    """One mail a document: headers from its columns, the text as its body."""
    d = documents(spark, sf)
    body = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Content-Transfer-Encoding: base64\n\n"), F.base64(F.encode(body, "UTF-8")))).when(F.col("doc_id") % 3 == 2, F.concat(F.lit("\n<html><body>"), body, F.lit("</body></html>"))).otherwise(F.concat(F.lit("\n"), body))
    html = F.when(F.col("doc_id") % 3 == 2, "Content-Type: text/html\n").otherwise("Content-Type: text/plain\n")
    stamp = F.date_format(F.timestamp_seconds(F.col("doc_id") * 60 + 1_000_000_000), "d MMM yyyy HH:mm:ss")
    head = F.concat(F.lit("From sender\nFrom: Writer <writer"), F.col("doc_id"), F.lit("@example.org>\nTo: reader@example.net\nSubject: "), F.coalesce("source", F.lit("none")), F.lit("\nDate: "), stamp, F.lit(" +0000\n"), html)
    return d.select("doc_id", F.concat(head, kind).alias("raw"))


@query("mail_lines")
def mail_lines(spark, sf):
    x = messages(spark, sf).select("doc_id", F.posexplode(mail.lines_udf()("raw")).alias("line_no", "x"))
    return x.select("doc_id", "line_no", "x.cls", "x.line")


@query("mail_media_counts")
def mail_media_counts(spark, sf):
    x = messages(spark, sf).select("doc_id", F.explode(mail.lines_udf()("raw")).alias("x")).select("doc_id", F.col("x.cls").alias("cls"), F.col("x.line").alias("text"))
    return ft.counts(ft.token_rows(x, "adp"), "doc_id", "cls").groupBy("doc_id", "cls").agg(F.sum("cnt").alias("n"))


@query("mbox_split", r"""select md5(rtrim('From s' || doc_id || chr(10) || 'Subject: ' || coalesce(source, '') || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '(^|\n\n)From ', '\1>From ', 'g'), chr(10))) as digest from documents""")
def mbox_split(spark, sf):
    """Messages put in mailboxes of two, and split again."""
    raw = F.concat(F.lit("From s"), F.col("doc_id").cast("string"), F.lit("\nSubject: "), F.coalesce("source", F.lit("")), F.lit("\n\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "(\\A|\n\n)From ", "$1>From "))
    pair = documents(spark, sf).select("doc_id", raw.alias("raw")).withColumn("box", F.floor(F.col("doc_id") / 2)).groupBy("box").agg(F.concat_ws("\n\n", F.array_sort(F.collect_list("raw"))).alias("box_text"))  # two a box
    return pair.select(F.explode(mail.split_mbox(F.col("box_text"))).alias("raw")).select(F.md5(F.regexp_replace("raw", "\n+\\z", "")).alias("digest"))


@query("header_conformance", """select doc_id, case doc_id % 4 when 0 then 'rfc822,rfc2822,rfc2822-obs,rfc2822-lax' when 1 then 'rfc2822-obs,rfc2822-lax' when 2 then 'rfc822,rfc2822,rfc2822-obs,rfc2822-lax' else '' end as conforms from documents""")
def header_conformance(spark, sf):
    """Senders in four forms: plain, with a dot in the name, with a comment in a comment, and without a host."""
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    form = F.when(k == 0, F.concat(F.lit("W"), n, F.lit(" <w@example.org>"))).when(k == 1, F.concat(F.lit("W. "), n, F.lit(" <w@example.org>"))).when(k == 2, F.concat(F.lit("w@example.org (the (real) number "), n, F.lit(")"))).otherwise(F.concat(F.lit("W <w@"), F.lit(">")))
    h = documents(spark, sf).select("doc_id", headers.headers_udf(F.concat(F.lit("From: "), form, F.lit("\n\n"))).alias("h"))
    return h.select("doc_id", F.array_join(F.col("h")[0]["conforms"], ",").alias("conforms"))


@query("mail_headers", "select doc_id, 'writer' || doc_id || '@example.org' as sender, (doc_id * 60 + 1000000000)::bigint as epoch from documents")
def mail_headers(spark, sf):
    h = messages(spark, sf).select("doc_id", headers.headers_udf("raw").alias("h"))
    pick = lambda tag: F.filter("h", lambda x: x["tag"] == tag)[0]
    return h.select("doc_id", pick("from")["addresses"][0].alias("sender"), pick("date")["epoch"].alias("epoch"))

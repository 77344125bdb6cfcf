"""From documents to token and n-gram counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def line_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a line: the other columns, line_no (from 0) and line."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(tx.lines(F.col(text))).alias("line_no", "line"))


def token_rows(docs: DataFrame, tokenizer: str = "alpha", text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """One row a token (order 1), in no order: lines don't matter to single tokens."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.explode(tx.tokens(F.col(text), tokenizer, case_sensitive)).alias("gram")).withColumn("ord", F.lit(1))


def gram_rows(docs: DataFrame, order: int, tokenizer: str = "alpha", text: str = "text", straddle: bool = False, case_sensitive: bool = False, least: int = 1) -> DataFrame:
    """One row an n-gram of order least .. order, as in tx.grams. Windows end with their line unless they straddle lines.

    Grams are put together from rows a token, in compiled code: functions over arrays of arrays took several times as long.
    """
    rest = [c for c in docs.columns if c != text]
    if straddle:
        d = docs.select(*rest, tx.tokens(F.col(text), tokenizer, case_sensitive).alias("toks_"))
    else:
        d = line_rows(docs, text).select(*rest, tx.closed_tokens(F.col("line"), tokenizer, case_sensitive).alias("toks_"))
    d = d.select(*rest, "toks_", F.posexplode_outer("toks_").alias("i_", "t_"))  # outer: else tokens are found again for a filter
    run, grams = F.col("t_"), []
    for k in range(1, order + 1):
        if k > 1:
            run = F.concat(F.get("toks_", F.col("i_") - (k - 1)), F.lit(" "), run)
        if k >= least:
            grams.append(F.when(run != "" if k == 1 else F.col("i_") >= k - 1, F.struct(F.lit(k).alias("ord"), run.alias("gram"))))
    return d.select(*rest, F.explode(F.array(*grams)).alias("g_")).where("g_ is not null").select(*rest, "g_.ord", "g_.gram")


def counts(grams: DataFrame, *by: str) -> DataFrame:
    """Feature counts (by cls too, if the rows have it): partial sums before the shuffle, so a frequent token costs a task one row."""
    cls = ["cls"] if "cls" in grams.columns and "cls" not in by else []
    return grams.groupBy(*by, *cls, "ord", "gram").agg(F.count("*").alias("cnt"))


def distinct_rows(docs: DataFrame, *by: str) -> bool:
    """Whether no two rows have the same values of by."""
    return docs.groupBy(*by).agg(F.count("*").alias("n_")).where("n_ > 1").isEmpty()


def row_counts(docs: DataFrame, *by: str, tokenizer: str = "alpha", text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """Counts (by, ord, gram, cnt) of the tokens of each row, made within the row: the values of by must tell rows apart."""
    d = docs.select(*by, F.sort_array(tx.tokens(F.col(text), tokenizer, case_sensitive)).alias("toks_"))
    n = F.size("toks_")
    first = lambda i: (i < n) & ((i == 0) | (F.get("toks_", i) != F.get("toks_", i - 1)))
    d = d.select(*by, "toks_", F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), first).alias("at_"))  # where a token of its own begins
    d = d.select(*by, "toks_", "at_", F.posexplode_outer("at_").alias("k_", "i_")).where("i_ is not null")
    return d.select(*by, F.lit(1).alias("ord"), F.get("toks_", F.col("i_")).alias("gram"), (F.coalesce(F.get("at_", F.col("k_") + 1), F.size("toks_")) - F.col("i_")).cast("long").alias("cnt"))


def token_counts(docs: DataFrame, *by: str, tokenizer: str = "alpha", text: str = "text") -> DataFrame:
    """Counts (by, ord, gram, cnt) of tokens: within rows if by tells them apart, so that no counts are sent, else by a sum over rows."""
    if distinct_rows(docs, *by):
        return row_counts(docs, *by, tokenizer=tokenizer, text=text)
    return counts(token_rows(docs.select(*by, text), tokenizer, text), *by)


def forced(rows: DataFrame) -> DataFrame:
    """Grams or counts with every gram taken as a feature of order 1, for models of independent features."""
    return rows.withColumn("ord", F.lit(1))


def or_forced(counts_: DataFrame, *by: str) -> DataFrame:
    """Counts, where a model (value of by) that has no grams of order 1 has all its grams taken as such."""
    least = counts_.groupBy(*by).agg(F.min("ord").alias("least_"))
    key = [F.col(b).eqNullSafe(F.col(f"{b}_")) for b in by]
    least = F.broadcast(least.withColumnsRenamed({b: f"{b}_" for b in by}))  # a row a model
    found = counts_.join(least, key) if by else counts_.crossJoin(least)
    return found.withColumn("ord", F.when(F.col("least_") > 1, 1).otherwise(F.col("ord"))).select(*counts_.columns)


def merge(*tables: DataFrame) -> DataFrame:
    """Counts of several learners taken together: exactly those of learning all at once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*[c for c in out.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt"))


def decimate(docs: DataFrame, d: int, key: str = "doc_id") -> DataFrame:
    """About one document in 2^d, the same ones each time."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return docs.where(h % (1 << d) == 0)


def reservoir(docs: DataFrame, n: int = 25, key: str = "doc_id") -> DataFrame:
    """n documents by the order of a hash: a fixed stand-in for a random reservoir."""
    return docs.withColumn("draw", F.md5(F.col(key).cast("string"))).orderBy("draw", key).limit(n)


def min_count(features: DataFrame, threshold: int) -> DataFrame:
    """Features over the threshold; a negative one counts down from the largest count, and one that stays negative keeps all."""
    if threshold < 0:
        top = features.agg(F.max("cnt").alias("tmax"))
        cut = F.greatest(F.lit(0), F.col("tmax") + threshold)
        return features.crossJoin(F.broadcast(top)).where(F.col("cnt") > cut).drop("tmax")  # one row
    return features.where(F.col("cnt") > threshold)


def entropy(cnt: Column, total: Column) -> Column:
    """Of counts in a group whose total is known: sum this over the group."""
    p = cnt / total
    return -p * F.log(p)


def doc_entropy(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: tokens, distinct tokens, entropy in nats of its token distribution."""
    c = token_counts(docs, key)
    g = c.groupBy(key).agg(F.sum("cnt").alias("tokens"), F.count("*").alias("types"), F.sum(F.col("cnt") * F.log("cnt")).alias("clogc"))
    return g.select(key, "tokens", "types", (F.log("tokens") - F.col("clogc") / F.col("tokens")).alias("shannon"))


def transitions(features: DataFrame, *by: str) -> DataFrame:
    """Digram counts (i, j, n) of order-1 features: byte i is followed by byte j; 1 stands at both ends."""
    h = F.concat(F.lit("01"), F.hex("gram"), F.lit("01"))
    at = F.transform(F.sequence(F.lit(0), F.octet_length("gram")), lambda k: F.substring(h, k * 2 + 1, F.lit(4)))
    rows = features.where("ord = 1").select(*by, "cnt", F.explode(at).alias("t"))
    pairs = rows.groupBy(*by, "t").agg(F.sum("cnt").alias("n"))
    code = lambda a: F.greatest(F.conv(F.substring("t", a, 2), 16, 10).cast("int"), F.lit(1))
    return pairs.select(*by, code(1).alias("i"), code(3).alias("j"), "n")

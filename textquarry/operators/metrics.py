"""Tokenizer metrics over one tokenized table: (doc_id, text, tokens), tokens an array."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions import arrow as A, text as T
from textquarry.operators import stats

SPECIAL = ("[PAD]", "[UNK]", "[BOS]", "[EOS]", "[MASK]")


def token_counts(tok: DataFrame) -> DataFrame:
    return tok.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def vocab_coverage(tok: DataFrame, vocab: DataFrame) -> DataFrame:
    """(vocab_size, used, coverage): the share of a vocabulary (token) that occurs in the tokens."""
    v = vocab.select("token").distinct()
    used = v.join(tok.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi").agg(F.count("*").alias("used"))
    return v.agg(F.count("*").alias("vocab_size")).crossJoin(used).select("vocab_size", "used", F.round(F.col("used") / F.col("vocab_size"), 6).alias("coverage"))


def compression(tok: DataFrame) -> DataFrame:
    """Characters per token: over all, and of each text (mean, median, sample deviation, least, greatest)."""
    n = F.size("tokens")
    r = tok.select(F.length("text").alias("c"), n.alias("n"), F.when(n > 0, F.length("text") / n).otherwise(0.0).alias("r"))
    # The median is that of the ratios to six digits, counted before: few distinct values, whatever the number of texts.
    r = r.groupBy(F.round("r", 6).alias("r6")).agg(F.count("*").alias("k"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    k, s, q = F.sum("k"), F.sum("s"), F.sum("q")
    spread = F.greatest(q - s * s / k, F.lit(0.0))
    return r.agg(F.round(F.sum("c") / F.sum("n"), 6).alias("total_ratio"), F.round(s / k, 6).alias("mean_ratio"), F.round(F.percentile("r6", F.lit(0.5), F.col("k")), 6).alias("median_ratio"), F.round(F.when(k > 1, F.sqrt(spread / (k - 1))), 6).alias("std_ratio"), F.round(F.sqrt(spread / k), 6).alias("std_pop_ratio"), F.round(F.min("lo"), 6).alias("min_ratio"), F.round(F.max("hi"), 6).alias("max_ratio"))


def token_frequency(tok: DataFrame) -> DataFrame:
    return token_counts(tok).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.round(F.count("*") / F.sum("n"), 6).alias("diversity"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.max("n").alias("max"), F.min("n").alias("min"))


def rare_tokens(tok: DataFrame, at_most: int = 2) -> DataFrame:
    c = token_counts(tok)
    rare, single = F.count_if(F.col("n") <= at_most), F.count_if(F.col("n") == 1)
    return c.agg(F.count("*").alias("distinct"), rare.alias("rare"), single.alias("singletons"), F.round(rare / F.count("*"), 6).alias("rare_ratio"), F.round(single / F.count("*"), 6).alias("singleton_ratio"))


def token_length(tok: DataFrame) -> DataFrame:
    n = tok.select(F.explode("tokens").alias("token")).select(F.length("token").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.min("n").alias("min"), F.max("n").alias("max"), F.round(F.stddev_samp("n"), 6).alias("std"))


def token_length_histogram(tok: DataFrame) -> DataFrame:
    return tok.select(F.explode("tokens").alias("token")).groupBy(F.length("token").alias("length")).agg(F.count("*").alias("n"))


def sequence_length(tok: DataFrame) -> DataFrame:
    n = tok.select(F.size("tokens").alias("n"))
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), *(F.round(p[k], 6).alias(a) for k, a in enumerate(("median", "p90", "p95", "p99"))), F.min("n").alias("min"), F.max("n").alias("max"), F.round(F.stddev_samp("n"), 6).alias("std"))


def special_usage(tok: DataFrame, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """(token, n, rate) of each special token, 0 where it doesn't occur."""
    spark = tok.sparkSession
    names = spark.createDataFrame([(s,) for s in special], "token string")
    c = token_counts(tok)
    total = c.agg(F.sum("n").alias("total"))
    return names.join(c, "token", "left").crossJoin(total).select("token", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 8).alias("rate"))


def unk_analysis(tok: DataFrame, unk: str = "[UNK]") -> DataFrame:
    n = F.size(F.filter("tokens", lambda t: t == unk))
    r = tok.select(n.alias("u"), F.size("tokens").alias("n"))
    return r.agg(F.sum("u").alias("unk"), F.sum("n").alias("total"), F.round(F.sum("u") / F.sum("n"), 8).alias("unk_rate"), F.count_if(F.col("u") > 0).alias("texts_with_unk"))


def coverage(tok: DataFrame, unk: str = "[UNK]") -> DataFrame:
    """Share of tokens that aren't unknown, and tokens per word of each text (mean, least, greatest)."""
    words, u = T.n_words(F.col("text")), F.size(F.filter("tokens", lambda t: t == unk))
    r = tok.where(F.length("text") > 0).select(F.size("tokens").alias("n"), u.alias("u"), words.alias("w"))
    per = F.when(F.col("w") > 0, F.col("n") / F.col("w"))
    return r.agg(F.round(1 - F.sum("u") / F.sum("n"), 6).alias("coverage"), F.round(F.sum("n") / F.sum("w"), 6).alias("tokens_per_word"), F.round(F.avg(per), 6).alias("mean_per_text"), F.round(F.min(per), 6).alias("min_per_text"), F.round(F.max(per), 6).alias("max_per_text"))


def diversity(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each text's lower-case words: type/token ratio, share of words used once, Shannon entropy, Simpson index."""
    s = A.diversity(df, T.words(F.lower(F.col(text_col))), id_col)
    t = F.col("total")
    return s.select(id_col, "total", F.round(F.col("types") / t, 6).alias("ttr"), F.round(F.col("once") / F.col("types"), 6).alias("hapax"), F.round(F.log2(t) - F.col("x") / t, 5).alias("entropy"), F.round(F.when(t > 1, 1 - F.col("y") / (t * (t - 1))).otherwise(0.0), 6).alias("simpson"))


def token_distribution(tok: DataFrame) -> DataFrame:
    c = token_counts(tok)
    s = c.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.stddev_pop("n").alias("std"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    return s.select("total", "distinct", "min", "max", F.round("mean", 6).alias("mean"), "median", F.round("std", 5).alias("std"), F.round(F.log2("total") - F.col("x") / F.col("total"), 5).alias("entropy"))


def token_histogram(tok: DataFrame, bins: int = 50) -> DataFrame:
    return stats.histogram(token_counts(tok), F.col("n"), bins)


def consistency(df: DataFrame, encode: Callable[[Column], Column], share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How much of the encoding of a text's first part is the beginning of the whole text's encoding.

    (doc_id, prefix_tokens, stable, share): stable counts the equal tokens before the first difference.
    """
    t = F.col(text_col)
    e = df.where(F.length(t) > 0).select(id_col, encode(F.substring(t, F.lit(1), F.floor(F.length(t) * share).cast("int"))).alias("p"), encode(t).alias("f"))
    same = F.zip_with("p", F.slice("f", F.lit(1), F.size("p")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, False)
    stable = F.when(differs > 0, differs - 1).otherwise(F.size("p")).cast("int")
    return e.select(id_col, F.size("p").alias("prefix_tokens"), stable.alias("stable"), F.round(F.when(F.size("p") > 0, stable / F.size("p")).otherwise(1.0), 6).alias("share"))


def reconstruction(df: DataFrame, decoded_col: str = "decoded", text_col: str = "text") -> DataFrame:
    """Perfect matches and character error rate (edit distance over characters) of decoded texts."""
    same = F.col(text_col) == F.col(decoded_col)
    d = F.when(same, 0).otherwise(F.levenshtein(text_col, decoded_col))
    return df.select(same.alias("same"), d.alias("d"), F.length(text_col).alias("n")).agg(F.count("*").alias("texts"), F.count_if("same").alias("perfect"), F.sum("d").cast("long").alias("distance"), F.round(F.sum("d") / F.sum("n"), 6).alias("cer"))


def reversibility(df: DataFrame, decoded_col: str = "decoded", text_col: str = "text") -> DataFrame:
    s = F.when(F.col(text_col) == F.col(decoded_col), 1.0).otherwise(T.similarity(F.col(text_col), F.col(decoded_col)))
    return df.agg(F.round(F.avg(s), 6).alias("similarity"), F.round(F.avg((F.col(text_col) == F.col(decoded_col)).cast("int")), 6).alias("exact_ratio"))


def matching_ratio(a: Column, b: Column) -> Column:
    """100 times the share of characters in the matching blocks of both texts (difflib), by Arrow."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        import difflib

        return pd.Series([None if p is None or q is None else 100.0 * difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y)])

    return run(a, b)


def differences(a: Column, b: Column) -> Column:
    """Characters (added, removed, changed) between two texts, by Arrow."""

    @F.pandas_udf("struct<added:int,removed:int,changed:int>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        import difflib

        rows = []
        for p, q in zip(x, y):
            n = {"insert": 0, "delete": 0, "replace": 0, "equal": 0}
            for op, i, j, k, m in difflib.SequenceMatcher(None, p or "", q or "", autojunk=False).get_opcodes():
                n[op] += max(j - i, m - k)
            rows.append((n["insert"], n["delete"], n["replace"]))
        return pd.DataFrame(rows, columns=["added", "removed", "changed"])

    return run(a, b)


def by_category(tok: DataFrame, category: str) -> DataFrame:
    """Per category and, with a null category, over all: texts, characters, tokens and their ratios."""
    r = tok.select(category, F.length("text").alias("c"), F.size("tokens").alias("n"))
    return r.rollup(category).agg(F.count("*").alias("texts"), F.sum("c").alias("chars"), F.sum("n").alias("tokens"), F.round(F.sum("c") / F.sum("n"), 6).alias("chars_per_token"), F.round(F.avg("n"), 6).alias("tokens_per_text"))


def best_and_worst(tok: DataFrame, category: str) -> DataFrame:
    c = by_category(tok, category).where(F.col(category).isNotNull())
    return c.agg(F.max_by(category, F.struct("chars_per_token", category)).alias("best"), F.min_by(category, F.struct("chars_per_token", category)).alias("worst"))


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "compression": compression, "token_frequency": token_frequency, "rare_tokens": rare_tokens, "token_length": token_length,
    "sequence_length": sequence_length, "special_usage": special_usage, "unk_analysis": unk_analysis, "coverage": coverage, "token_distribution": token_distribution,
}


def evaluate(tok: DataFrame, names: list[str] | None = None, extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """The named metrics (all by default) over a tokenized table, with user metrics by name."""
    known = METRICS | (extra or {})
    return {n: known[n](tok) for n in (names or known)}


def rare_examples(tok: DataFrame, at_most: int = 2, k: int = 20) -> DataFrame:
    """(token, n): the k rarest tokens; ties in order of the token."""
    return token_counts(tok).where(F.col("n") <= at_most).orderBy("n", "token").limit(k)


def unk_examples(tok: DataFrame, unk: str = "[UNK]", k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, unk, tokens, rate): the k texts with the highest share of unknown tokens."""
    n, u = F.size("tokens"), F.size(F.filter("tokens", lambda t: t == unk))
    r = tok.select(id_col, u.alias("unk"), n.alias("tokens")).where("unk > 0")
    return r.orderBy(F.desc(F.col("unk") / F.col("tokens")), id_col).limit(k).withColumn("rate", F.round(F.col("unk") / F.col("tokens"), 6))


def quality(tok: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: a tokenization beside that of a reference tokenizer over the same texts.

    Characters per token of both and their ratio, distinct tokens of both, the share of ours that the reference uses too, and tokens
    for each token of the reference.
    """
    total = lambda t: t.agg(F.sum(F.length("text")).alias("c"), F.sum(F.size("tokens")).alias("n"))
    kinds = lambda t: t.select(F.explode("tokens").alias("token")).distinct()
    a, b = kinds(tok), kinds(reference)
    x = total(tok).toDF("ca", "na").crossJoin(total(reference).toDF("cb", "nb"))
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "token", "full").agg(F.count("x").alias("va"), F.count("y").alias("vb"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("sh"))
    ra, rb = F.col("ca") / F.col("na"), F.col("cb") / F.col("nb")
    return x.crossJoin(both).select(F.round(ra, 6).alias("chars_per_token"), F.round(rb, 6).alias("reference_chars_per_token"), F.round(ra / rb, 6).alias("compression_vs_reference"), F.col("va").alias("distinct_tokens"), F.col("vb").alias("reference_distinct_tokens"), F.round(F.col("sh") / F.col("va"), 6).alias("shared_with_reference"), F.round(F.col("na") / F.col("nb"), 6).alias("tokens_vs_reference"))


def speed(df: DataFrame, encode: Callable[[Column], Column], decode: Callable[[Column], Column] | None = None, repeats: int = 3, text_col: str = "text") -> dict:
    """Characters and tokens a second of encoding (and of decoding) the whole table, the mean of some runs; nothing is kept of the results."""
    import time

    size = df.agg(F.sum(F.length(text_col)).alias("c"), F.sum(F.size(encode(F.col(text_col)))).alias("n")).first()
    out = {"chars": size.c or 0, "tokens": size.n or 0}
    steps = {"encode": df.select(encode(F.col(text_col)).alias("ids"))}
    if decode is not None:
        steps["decode"] = df.select(decode(encode(F.col(text_col))).alias("text"))
    for name, plan in steps.items():
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            plan.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        mean = sum(took) / len(took)
        out |= {f"{name}_seconds": mean, f"{name}_chars_per_second": out["chars"] / mean, f"{name}_tokens_per_second": out["tokens"] / mean}
    return out


def roundtrip(df: DataFrame, encode: Callable[[Column], Column], decode: Callable[[Column], Column], category: str | None = None, text_col: str = "text") -> DataFrame:
    """(category, texts, exact, exact_percent, tokens, chars_per_token) by category and over all (a null category)."""
    x = df.select(F.col(category).alias("category") if category else F.lit(None).cast("string").alias("category"), F.col(text_col).alias("t"), encode(F.col(text_col)).alias("ids"))
    x = x.select("category", F.length("t").alias("c"), F.size("ids").alias("n"), (decode(F.col("ids")) == F.col("t")).alias("same"))
    out = x.rollup("category") if category else x.groupBy("category")
    return out.agg(F.count("*").alias("texts"), F.count_if("same").alias("exact"), F.round(100 * F.count_if("same") / F.count("*"), 4).alias("exact_percent"), F.sum("n").alias("tokens"), F.round(F.sum("c") / F.sum("n"), 6).alias("chars_per_token"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tokenizations of the same texts side by side: ratios and their difference."""
    x, y = compression(a).select(F.col("total_ratio").alias("ratio_a")), compression(b).select(F.col("total_ratio").alias("ratio_b"))
    return x.crossJoin(y).withColumn("difference", F.round(F.col("ratio_a") - F.col("ratio_b"), 6))

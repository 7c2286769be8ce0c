"""Corpus profiles: per row, over the whole table, and over its words and characters."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions import arrow as A, text as T


def row_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    w = T.words(F.col(text_col))
    return df.select(id_col, F.length(text_col).alias("length"), F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("unique_words"), F.size(F.array_distinct(T.chars(F.col(text_col)))).alias("unique_chars"))


def _aggregates() -> list[Column]:
    out = [F.count("*").alias("sample_count")]
    for c in ("chars", "words"):
        p = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out += [F.sum(c).alias(f"total_{c}"), F.round(F.avg(c), 6).alias(f"avg_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.round(F.stddev_samp(c), 6).alias(f"std_{c}")]
        out += [p[k].alias(f"{n}_{c}") for k, n in enumerate(("p25", "median", "p75"))]
    return out


def _measured(df: DataFrame, text_col: str) -> DataFrame:
    return df.where(F.length(text_col) > 0).withColumns({"chars": F.length(text_col), "words": T.n_words(F.col(text_col))})


def dataset_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of counts, sums, means and exact percentiles; empty texts are left out."""
    return _measured(df, text_col).agg(*_aggregates())


def group_stats(df: DataFrame, group_col: str, text_col: str = "text") -> DataFrame:
    """The same for each group and, with a null group, over all: one pass by rollup."""
    return _measured(df, text_col).rollup(group_col).agg(*_aggregates())


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select(F.explode(T.words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int, key: str, n: str = "n") -> DataFrame:
    """The k most frequent; ties in order of the key."""
    return counts.orderBy(F.desc(n), key).limit(k)


def char_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return A.char_counts(df, text_col)


def text_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines, words per line, characters per word and lexical diversity of each text."""
    t = F.col(text_col)
    w = T.words(t)
    lines = F.size(F.split(t, "\n"))
    n = F.size(w)
    return df.select(id_col, F.length(t).alias("chars"), n.alias("words"), lines.alias("lines"), F.round(n / lines, 6).alias("words_per_line"), F.round(F.when(n > 0, F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)) / n).otherwise(0.0), 6).alias("chars_per_word"), F.round(F.when(n > 0, F.size(F.array_distinct(w)) / n).otherwise(0.0), 6).alias("lexical_diversity"))


def vocabulary_estimate(counts: DataFrame, min_frequency: int = 2, n: str = "n") -> DataFrame:
    """(distinct, kept, total, covered) of a table of counts."""
    kept = F.col(n) >= min_frequency
    return counts.agg(F.count("*").alias("distinct"), F.count_if(kept).alias("kept"), F.sum(n).alias("total"), F.sum(F.when(kept, F.col(n)).otherwise(0)).alias("covered"))


def byte_estimate(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(label, n): code points as <hex>, as the byte strategy of the vocabulary estimate names them."""
    return char_counts(df, text_col).select(F.concat(F.lit("<"), F.lower(F.hex(F.ascii("ch"))), F.lit(">")).alias("label"), "n")


def bpe_estimate(chars: DataFrame, min_frequency: int = 2, merges: int | None = None) -> DataFrame:
    """Kept characters plus the smaller of the merges and five times the kept (merges: half of the kept)."""
    kept = F.count_if(F.col("n") >= min_frequency)
    m = F.lit(merges) if merges is not None else F.floor(F.col("kept") / 2)
    return chars.agg(kept.alias("kept")).select("kept", (F.col("kept") + F.least(m, 5 * F.col("kept"))).cast("long").alias("estimate"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, low, high, n) with equal widths from the least to the greatest value; the last bin is closed."""
    v = df.select(value.cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = v.crossJoin(F.broadcast(ends)).where("v is not null").select(F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width))).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").crossJoin(F.broadcast(ends)).select("bin", F.round(F.col("lo") + F.col("bin") * width, 6).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def report(df: DataFrame, text_col: str = "text") -> str:
    """A Markdown report of the corpus (made on the driver, from aggregates)."""
    s = dataset_stats(df, text_col).first().asDict()
    lines = ["# Corpus report", "", "| measure | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in s.items())]
    for title, counts, key in (("Words", word_counts(df, text_col), "word"), ("Characters", char_counts(df, text_col), "ch")):
        lines += ["", f"## {title}", "", "| item | count |", "| --- | --- |", *(f"| {r[key]!r} | {r['n']} |" for r in top(counts, 20, key).collect())]
    return "\n".join(lines) + "\n"


def top_chars(df: DataFrame, k: int = 10, text_col: str = "text") -> DataFrame:
    """(ch, n): the k most frequent characters."""
    return top(char_counts(df, text_col), k, "ch")


def save_stats(df: DataFrame, path: str, text_col: str = "text") -> dict:
    """The corpus profile as JSON: sizes, and the 20 most frequent words and 10 most frequent characters."""
    from textquarry.sources.writers import write_file

    out = dataset_stats(df, text_col).first().asDict()
    out["top_words"] = {r.word: r.n for r in top(word_counts(df, text_col), 20, "word").collect()}
    out["top_chars"] = {r.ch: r.n for r in top_chars(df, 10, text_col).collect()}
    write_file(df.sparkSession, path, json.dumps(out, indent=1, ensure_ascii=False))
    return out

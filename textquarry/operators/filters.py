"""Filters: one expression names the first rule that a text breaks, in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions import text as T


@dataclass
class FilterConfig:
    min_length: int | None = None
    max_length: int | None = None
    min_words: int | None = None
    max_words: int | None = None
    required_words: list[str] = field(default_factory=list)
    excluded_words: list[str] = field(default_factory=list)
    required_patterns: list[str] = field(default_factory=list)
    excluded_patterns: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    language_col: str = "lang"
    custom: Column | None = None


def reject_reason(config: FilterConfig, text_col: str = "text") -> Column:
    """The first broken rule's name; null for a text to keep. Cheap rules come first and spare the rest."""
    t = F.col(text_col)
    low = F.lower(t)
    rules: list[tuple[str, Column]] = [("empty", t.isNull() | (t == ""))]
    if config.min_length is not None:
        rules.append(("min_length", F.length(t) < config.min_length))
    if config.max_length is not None:
        rules.append(("max_length", F.length(t) > config.max_length))
    if config.min_words is not None:
        rules.append(("min_words", T.n_words(t) < config.min_words))
    if config.max_words is not None:
        rules.append(("max_words", T.n_words(t) > config.max_words))
    rules += [("required_words", ~low.contains(w.lower())) for w in config.required_words]
    rules += [("excluded_words", low.contains(w.lower())) for w in config.excluded_words]
    rules += [("required_patterns", ~t.rlike(p)) for p in config.required_patterns]
    rules += [("excluded_patterns", t.rlike(p)) for p in config.excluded_patterns]
    if config.languages:
        language = F.when(F.length(t) < 20, "unknown").otherwise(F.coalesce(F.col(config.language_col), F.lit("unknown")))
        rules.append(("language", ~language.isin(config.languages)))
    if config.custom is not None:
        rules.append(("custom", ~F.coalesce(config.custom, F.lit(False))))
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def keep(df: DataFrame, config: FilterConfig, text_col: str = "text") -> DataFrame:
    return df.where(reject_reason(config, text_col).isNull())


def reject_stats(df: DataFrame, config: FilterConfig, text_col: str = "text") -> DataFrame:
    """(reason, n): "kept" and each rule that rejected something."""
    return df.select(F.coalesce(reject_reason(config, text_col), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_STOP = {
    "en": "the of and to in is that it was for on are with as his they at be this from",
    "fr": "le la les et des du une que est dans pour qui sur pas au avec par plus ce il",
    "de": "der die und das ist nicht ein eine zu den mit von im dem auf sich auch es für als",
    "es": "el los que y en un por con una para es las del se lo como más pero sus al",
    "tr": "ve bir bu için ile da de çok daha gibi olarak ama ne kadar sonra en her mi var ki",
}


def detect_language(text: Column) -> Column:
    """The language with most stop words among a text's words; "unknown" below 20 characters or without any.

    Ties go to the alphabetically first language. Words are split and looked up batch by batch.
    """
    langs = sorted(_STOP)
    listed = sorted({w for ws in _STOP.values() for w in ws.split()})
    member = np.array([[w in _STOP[lang].split() for lang in langs] for w in listed])

    @F.arrow_udf("string")
    def run(t: pa.Array) -> pa.Array:
        words = pc.utf8_split_whitespace(pc.utf8_lower(t))
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(words.flatten(), value_set=pa.array(listed)), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(t)), n)[at >= 0]
        score = np.stack([np.bincount(row, weights=member[at[at >= 0], k], minlength=len(t)) for k in range(len(langs))], axis=1)
        best = pa.array(langs).take(pa.array(score.argmax(axis=1) if len(t) else np.zeros(0, np.int64)))
        known = (score.max(axis=1, initial=0) > 0) & (pc.fill_null(pc.utf8_length(t), 0).to_numpy(zero_copy_only=False) >= 20)
        return pc.if_else(pa.array(known), best, "unknown")

    return run(text)

"""Text cleaning: a fixed order of steps, each switched by a field of the configuration."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from textquarry.functions import text as T, unicode as U
from textquarry.functions.shared import once


@dataclass
class CleanConfig:
    fix_html: bool = True
    fix_unicode: bool = True
    strip_accents: bool = True
    replace_urls: bool = False
    replace_emails: bool = False
    replace_numbers: bool = False
    replace_digits: bool = False
    replace_currency: bool = False
    remove_punctuation: bool = False
    remove_line_breaks: bool = False
    squeeze: bool = True
    lowercase: bool = False
    custom: list[tuple[str, str]] = field(default_factory=list)
    min_length: int = 0
    max_length: int | None = None

    def expression(self, text: Column) -> Column:
        """All steps but the length rules. The Unicode steps share one Arrow function; the rest is native."""
        if self.fix_html or self.fix_unicode or self.strip_accents:
            text = U.fix(text, self.fix_html, self.fix_unicode, self.strip_accents)
        steps: list[tuple[bool, Callable[[Column], Column]]] = [
            (self.replace_urls, T.replace_urls),
            (self.replace_emails, T.replace_emails),
            (self.replace_numbers, T.replace_numbers),
            (self.replace_digits, T.replace_digits),
            (self.replace_currency, T.replace_currency),
            (self.remove_punctuation, T.remove_punctuation),
            (self.remove_line_breaks, T.remove_line_breaks),
            (self.squeeze, T.squeeze),
            (self.lowercase, F.lower),
        ]
        text = reduce(lambda t, s: s[1](t) if s[0] else t, steps, text)
        return T.custom_replacements(text, self.custom)


def clean_text(config: CleanConfig, text_col: str = "text", keep_empty: bool = False) -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform: cleans the column, cuts it at the maximum, drops short and empty texts."""

    def run(df: DataFrame) -> DataFrame:
        # All steps by one projection of their own: the length rules below read its result, they don't repeat it.
        out = once(df, {text_col: F.coalesce(config.expression(F.col(text_col)), F.lit(""))})
        if not keep_empty:
            out = out.where(F.length(text_col) >= max(1, config.min_length))
        elif config.min_length:
            out = out.withColumn(text_col, F.when(F.length(text_col) >= config.min_length, F.col(text_col)).otherwise(""))
        return out if config.max_length is None else out.withColumn(text_col, F.substring(text_col, 1, config.max_length))

    return run


def replacement_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: how many URLs, e-mails, numbers and currency signs there are to replace."""
    count = lambda p: F.sum(F.regexp_count(F.col(text_col), F.lit(p)))
    return df.agg(count(T.URL).alias("urls"), count(T.EMAIL).alias("emails"), count("(?U)" + T.NUMBER).alias("numbers"), count(T.CURRENCY).alias("currency"))


def observed(df: DataFrame, name: str, text_col: str = "text") -> tuple[DataFrame, Observation]:
    """Counts rows and characters as they pass; the values are there after an action."""
    o = Observation(name)
    return df.observe(o, F.count("*").alias("rows"), F.sum(F.length(text_col)).alias("chars")), o


def pipeline(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], text_col: str = "text", skip_empty: bool = True) -> DataFrame:
    """Steps in order; rows that a step leaves empty go no further."""
    for step in steps:
        df = df.transform(step)
        if skip_empty:
            df = df.where(F.length(text_col) > 0)
    return df


SUFFIX_LANGUAGE = {"py": "python", "js": "javascript", "ts": "javascript", "c": "c", "h": "c", "cpp": "c", "java": "java", "css": "css", "php": "php"}


def clean_by_suffix(df: DataFrame, path_col: str = "path", text_col: str = "text", config: CleanConfig | None = None, code=None) -> DataFrame:
    """Each file by its name: code of a known language by ``clean_code``, everything else by ``clean_text``; empty results go."""
    from textquarry.operators.code import clean_code

    language = language_of(F.col(path_col))
    plain = (config or CleanConfig()).expression(F.col(text_col))
    out = once(df, {text_col: F.when(language.isNotNull(), clean_code(F.col(text_col), language, code)).otherwise(plain)})
    return out.where(F.length(text_col) > 0)


def language_of(path: Column) -> Column:
    """The code language of a file name; null for text."""
    suffix = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, language in SUFFIX_LANGUAGE.items():
        out = F.when(suffix == name, language).otherwise(out)
    return out

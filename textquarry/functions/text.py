"""Column expressions over text: words, characters, bytes, pre-tokens, cleaning steps. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: White space as Python's str.split() has it (Java's (?U)\\s lacks the four separators 1c to 1f).
SPACE = "(?U)[\\s\\x1c-\\x1f]+"
URL = "https?://\\S+|www\\.\\S+"
EMAIL = "\\S+@\\S+\\.\\S+"
NUMBER = "\\b\\d+(?:\\.\\d+)?(?:[eE][-+]?\\d+)?\\b"
CURRENCY = "[$€£¥₹₽₩]"
#: Pieces that byte-level BPE is trained and applied on.
PRETOKEN = "'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def chars(text: Column) -> Column:
    """Code points, one string each."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def byte_values(text: Column) -> Column:
    """The UTF-8 bytes as integers; linear in the text."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), 0), lambda b: F.conv(b, 16, 10).cast("int"))


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), 0)


def sentences(text: Column) -> Column:
    """Pieces between sentence ends, trimmed; the marks stay with what they end."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?])(?U)\\s+"), strip), lambda s: s != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^(?U)[\\s\\x1c-\\x1f]+|(?U)[\\s\\x1c-\\x1f]+$", "")


def java_replacement(python: str) -> str:
    """A replacement in Python's notation (\\1) in Java's ($1)."""
    return re.sub(r"\\(\d)", r"$\1", python.replace("$", "\\$"))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE, " "))


def replace_urls(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + URL, " [URL] ")


def replace_emails(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + EMAIL, " [EMAIL] ")


def replace_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + NUMBER, " [NUMBER] ")


def replace_digits(text: Column) -> Column:
    return F.regexp_replace(text, "\\p{Nd}", "0")


def replace_currency(text: Column) -> Column:
    return F.regexp_replace(text, CURRENCY, " [CURRENCY] ")


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)[^\\w\\s]", " ")


def remove_line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "[\\r\\n]+", " ")


def custom_replacements(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, java_replacement(replacement))
    return text


def json_path(body: Column, path: str) -> Column:
    """A dotted path with list positions (a.b.0.c) in a JSON text; objects and lists come as JSON text."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(body, "$" + steps)


def extract(text: Column, pattern: str) -> Column:
    """Group 1 of the first match (group 0 without groups); the whole text if nothing matches."""
    group = 1 if re.compile(pattern).groups else 0
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).otherwise(text)


def similarity(a: Column, b: Column, sampled_above: int | None = None) -> Column:
    """1 - edit distance / longer length; texts longer than ``sampled_above`` (none by default) are compared in five slices of 100 characters."""
    longer = F.greatest(F.length(a), F.length(b))
    whole = F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)
    if sampled_above is None:
        return whole
    step = F.greatest(F.lit(1), F.floor((F.least(F.length(a), F.length(b)) - 100) / 4).cast("int"))
    parts = [(F.substr(a, F.lit(1) + k * step, F.lit(100)), F.substr(b, F.lit(1) + k * step, F.lit(100))) for k in range(5)]
    sampled = sum((1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)) for x, y in parts), F.lit(0.0)) / 5
    return F.when(longer > sampled_above, sampled).otherwise(whole)

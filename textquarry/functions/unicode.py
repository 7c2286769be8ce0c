"""Unicode steps for which Spark has no expression: one Arrow function for each combination, over whole batches."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from textquarry.functions.arrow import in_parts


@lru_cache(maxsize=2)
def _class(control: bool) -> str:
    """A class of RE2 with all characters of the categories C*, or else all that combine."""
    wanted = (lambda c: unicodedata.category(c)[0] == "C") if control else unicodedata.combining
    ranges: list[list[int]] = []
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000 or not wanted(chr(i)):
            continue
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]+"


def _unescaped(t: pa.Array) -> pa.Array:
    some = pc.fill_null(pc.match_substring(t, "&"), False)
    return pc.replace_with_mask(t, some, pa.array([html.unescape(x) for x in t.filter(some).to_pylist()], pa.string())) if pc.any(some).as_py() else t


_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _ended(x: str) -> str:
    return _ENTITY.sub(lambda m: html.unescape(m.group()) if m.group(1)[0] == "#" or m.group(1) + ";" in html.entities.html5 else m.group(), x)


def _unescaped_ended(t: pa.Array) -> pa.Array:
    """Only entities that a semicolon ends: a text cut within one keeps what is left of it."""
    some = pc.fill_null(pc.match_substring(t, "&"), False)
    return pc.replace_with_mask(t, some, pa.array([_ended(x) for x in t.filter(some).to_pylist()], pa.string())) if pc.any(some).as_py() else t


def _without_accents(t: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_normalize(t, form="NFKD"), pattern=_class(False), replacement="")


def _composed(form: str) -> Callable[[pa.Array], pa.Array]:
    """Arrow's own NFC and NFKC leave characters decomposed, so these two go text by text; ASCII stays as it is."""

    def step(t: pa.Array) -> pa.Array:
        some = pc.invert(pc.fill_null(pc.string_is_ascii(t), True))
        return pc.replace_with_mask(t, some, pa.array([unicodedata.normalize(form, x) for x in t.filter(some).to_pylist()], pa.string())) if pc.any(some).as_py() else t

    return step


def _arrow(steps: list[Callable[[pa.Array], pa.Array]], text: Column) -> Column:
    def part(t: pa.Array) -> pa.Array:
        for step in steps:
            t = step(t)
        return t

    @F.arrow_udf("string")
    def run(t: pa.Array) -> pa.Array:
        return in_parts(t, part)

    return run(text)


def fix(text: Column, fix_html: bool = True, nfc: bool = True, accents: bool = True, ended: bool = False) -> Column:
    """HTML entities to characters, then NFC, then NFKD without combining marks. ``ended``: only entities with their semicolon, not &amp as browsers have it."""
    # NFKD gives the same with and without NFC before it.
    steps = [(fix_html, _unescaped_ended if ended else _unescaped), (nfc and not accents, _composed("NFC")), (accents, _without_accents)]
    return _arrow([f for on, f in steps if on], text)


def normalize(text: Column, rule: str = "nfkc") -> Column:
    """nfc, nfkc, nfkd, or nmt_nfkc: NFKC without characters of the categories C*."""
    form = {"nfc": "NFC", "nfkc": "NFKC", "nfkd": "NFKD", "nmt_nfkc": "NFKC"}[rule]
    steps = [_composed(form) if form.endswith("C") else lambda t: pc.utf8_normalize(t, form=form)]
    if rule == "nmt_nfkc":
        steps.append(lambda t: pc.replace_substring_regex(t, pattern=_class(True), replacement=""))
    return _arrow(steps, text)

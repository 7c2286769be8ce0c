"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Text is folded (NFKC, lower case, zero-width characters out, homoglyphs to Latin letters, digits and signs that
stand for letters back to them), cut into words, and scanned once by an automaton that holds every entry of the
lexicon and every exception phrase. Entries are whole words or word beginnings ("abc*"). A match inside an exception
phrase doesn't count; a word counts once, with its heaviest entry. The score is the matched weight per 100 words,
with ``length_prior`` words added to each text so that one match in a tiny text isn't decisive by itself.

The lexicon is the given one and, where labels are given, entries with high smoothed log-odds in a bounded sample of
``max_labelled`` labelled documents; ``max_weight`` bounds a fitted weight, so that no single word decides about a long text, and the number of entries
has no bound but that sample's words. The threshold comes from the same sample, scored by lexicons fitted on the other
half of it.

Defined results: null text scores 0 and is not toxic; so does the empty text. Whole texts are scanned, however long.
Rows are judged one by one, so repeated rows and ties get equal verdicts. Extra columns pass through the filter
untouched, whatever their names. Empty tables give empty results. Without labels (or with labels of one kind) the given lexicon and
``DEFAULT_THRESHOLD`` are used.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.llm._util import checkpoint, fresh, table

SEED_LEXICON = {w: 4.0 for w in "idiot idiots moron morons scum pathetic worthless disgusting stupid loser losers trash clown imbecile bastard dumbass retard scumbag asshole bitch".split()}
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "white trash bag", "clown fish", "class clown", "circus clown", "idiot proof", "stupid simple", "pond scum", "soap scum", "sore loser clause")
DEFAULT_THRESHOLD = 2.0

_LATIN = "abcdefghijklmnopqrstuvwxyz"
_HOMOGLYPHS = str.maketrans(
    {a: b for a, b in zip("аеорсухіјѕһԁԛԝҽвкмнтгпɡıαβεικνορτυχωɑɩοⅼցսօհⲟ", "aeopcyxijshdqwebkmhtrngiabeiknoptuxwaiolguoho")}
    | dict.fromkeys("​‌‍⁠﻿­͏᠎")
)
_HAS_HOMOGLYPH = re.compile("[" + "".join(map(chr, _HOMOGLYPHS)) + "]")
_DIGITS = str.maketrans("013456789@$!|", "oieasgtbgasil")
_DIGIT_WORD = re.compile(r"(?:[^\W\d_]|[@$!|](?=[^\W_]))*(?:\d|(?<=\w)[@$!|](?=[^\W_]))(?:\w|[@$!|](?=[^\W_]))*")
_SIGN = re.compile(r"[\d@$!|]")
_LETTER = re.compile(r"[^\W\d_]")
_NOT_WORD = re.compile(r"[\W_]+")


def _digit_word(m: re.Match) -> str:
    word = m.group()
    return word.translate(_DIGITS) if _LETTER.search(word) else word


def _fold_letters(text: str) -> str:
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower()
        if _HAS_HOMOGLYPH.search(text):
            text = text.translate(_HOMOGLYPHS)
    else:
        text = text.lower()
    if _SIGN.search(text):
        text = _DIGIT_WORD.sub(_digit_word, text)
    return text


def _words(text: str) -> str:
    return " " + _NOT_WORD.sub(" ", text).strip() + " "


def fold(text: str) -> str:
    """The folded text as words between single spaces, with a space at either end."""
    return _words(_fold_letters(text))


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    threshold: float = DEFAULT_THRESHOLD
    length_prior: float = 20.0
    _machines: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machines": None}

    def machines(self) -> tuple:
        """The automaton of the entries with their word ends, and one that only tells whether any can be there."""
        if self._machines is None:
            import ahocorasick

            m, sieve = ahocorasick.Automaton(), ahocorasick.Automaton()
            entries: dict[str, tuple[float, int]] = {}
            for word, weight in self.lexicon.items():
                key = " " + fold(word.removesuffix("*")).strip()
                if key != " ":
                    key += "" if word.endswith("*") else " "
                    entries[key] = (max(weight, entries.get(key, (0, 0))[0]), len(key))
            for phrase in self.exceptions:
                if (key := fold(phrase)) != "  ":
                    entries[key] = (-1.0, len(key))
            for key, value in entries.items():
                m.add_word(key, value)
                if value[0] > 0:
                    sieve.add_word(max(key.split(), key=len), 0)
            m.make_automaton()
            sieve.make_automaton()
            self._machines = m, sieve
        return self._machines

    def score(self, text: str | None) -> tuple[float, int]:
        """Score and number of matched words."""
        if not text or not self.lexicon:
            return 0.0, 0
        machine, sieve = self.machines()
        letters, best, spared = _fold_letters(text), {}, []
        if next(sieve.iter(letters), None) is None:
            return 0.0, 0
        t = _words(letters)
        for end, (weight, n) in machine.iter(t):
            start = end - n + 1
            if weight < 0:
                spared.append((start, end))
            elif weight > best.get(start, 0):
                best[start] = weight
        if not best:
            return 0.0, 0
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        return 100.0 * sum(best.values()) / (t.count(" ") - 1 + self.length_prior), len(best)

    def toxic(self, text: str | None) -> bool:
        return self.score(text)[0] >= self.threshold


def _features(text: str) -> set[str]:
    words = set(fold(text).split())
    return words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = [Counter() for _ in range(4)]
    for b in batches:
        for text, y, half in zip(*(b.column(i).to_pylist() for i in range(3))):
            totals[2 * half + y].update(_features(text or ""))
            totals[2 * half + y][""] += 1
    for k, total in enumerate(totals):
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([k] * len(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["entry", "k", "n"])


def _lexicon(rows: list, halves: tuple[int, ...], min_docs: int, max_weight: float) -> dict[str, float]:
    get = lambda r, y: sum(r[f"n{2 * h + y}"] for h in halves)
    total = next((r for r in rows if r["entry"] == ""), None)
    bad, good = (get(total, 1), get(total, 0)) if total else (0, 0)
    if not bad or not good:
        return {}
    found = {}
    least = max(min_docs, bad // 200)
    for r in rows:
        a, b = get(r, 1), get(r, 0)
        if r["entry"] and a >= least and a / (a + b + 1) >= 0.7:
            found[r["entry"]] = (math.log((a + 0.5) / (bad + 1)) - math.log((b + 0.5) / (good + 1))) * a / (a + 1), a
    return {e: min(max_weight, w) for e, (w, _) in sorted(found.items()) if w >= 2.0}


def fit(docs: DataFrame, labels: DataFrame, *, seed_lexicon: dict[str, float] = SEED_LEXICON, exceptions: tuple[str, ...] = EXCEPTIONS, max_labelled: int = 10_000, min_docs: int = 3, max_weight: float = 6.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from at most ``max_labelled`` labelled documents (those of the smallest hashed ids)."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "id")  # bounded by max_labelled
    # Copies of one text are one document here, and of one half: half is a hash of the text.
    sample = checkpoint(sample.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y", F.pmod("h", F.lit(2)).cast("int").alias("half")))
    rows = (
        sample.mapInArrow(_counts, "entry string, k int, n long").groupBy("entry")
        .agg(*(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)))
        .where((F.col("entry") == "") | ((F.col("n1") + F.col("n3") >= min_docs) & (F.col("n1") + F.col("n3") > 2 * (F.col("n0") + F.col("n2")))))
        .collect()
    )
    halves = [ToxicityModel(dict(_lexicon(rows, (h,), min_docs, max_weight)) | seed_lexicon, exceptions) for h in (0, 1)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ys, half = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([halves[1 - h].score(t)[0] for t, h in zip(texts, half)], pa.float64()), pa.array(ys, pa.int32())], ["score", "y"])

    pairs = sorted(((r["score"], r["y"]) for r in sample.mapInArrow(scored, "score double, y int").collect()), reverse=True)
    lexicon = _lexicon(rows, (0, 1), min_docs, max_weight)
    for word, weight in seed_lexicon.items():
        lexicon[word] = max(weight, lexicon.get(word, 0))
    return ToxicityModel(lexicon, exceptions, _threshold(pairs))


def _threshold(pairs: list[tuple[float, int]]) -> float:
    """The cut with the best F1; within the gap that has it, a quarter of the way up from its lower end."""
    bad = sum(y for _, y in pairs)
    if not bad or bad == len(pairs):
        return DEFAULT_THRESHOLD
    best, cut, hit = 0.0, DEFAULT_THRESHOLD, 0
    for i, (score, y) in enumerate(pairs):
        hit += y
        low = pairs[i + 1][0] if i + 1 < len(pairs) else 0.0
        if score > low and score > 0 and (f1 := 2 * hit / (i + 1 + bad)) > best:
            best, cut = f1, low + (score - low) / 4
    return max(cut, 0.25)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, hits, toxic) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([round(s, 6) for s, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int32()), pa.array([s >= model.threshold for s, _ in got], pa.bool_())], ["doc_id", "score", "hits", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, score double, hits int, toxic boolean")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows that aren't toxic, with all their columns."""

    @F.pandas_udf("boolean")
    def bad(texts):
        return texts.map(lambda t: model.toxic(t) if isinstance(t, str) else False).astype(bool)

    mark = fresh(docs, "toxic_mark")
    return docs.withColumn(mark, bad(F.col(text_col).cast("string"))).where(~F.col(mark)).drop(mark)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}

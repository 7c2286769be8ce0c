"""Subword models over text with marked spaces: the usual options of such toolkits, on this library's trainers.

White space is squeezed and written as ``▁``, so that decoding gives the normalised text back. ``model_type`` is unigram, bpe, char or word.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textquarry.functions import arrow as A, text as T, unicode as U
from textquarry.operators import tokenizers as K

MARK = "▁"
_OTHER = {"unk": "<unk>", "bos": "<s>", "eos": "</s>", "pad": "<pad>"}


@dataclass
class SentencePiece:
    """Pieces with scores; ids: the control symbols, then ``user_symbols``, then pieces in order of their score."""

    model_type: str
    scores: dict[str, float]
    merges: list[tuple[str, str]]
    normalization: str = "nmt_nfkc"
    add_dummy_prefix: bool = True
    byte_fallback: bool = False
    user_symbols: tuple[str, ...] = ()

    def __post_init__(self):
        first = [*_OTHER.values(), *self.user_symbols, *((f"<0x{b:02X}>" for b in range(256)) if self.byte_fallback else ())]
        self.ids = {p: k for k, p in enumerate(dict.fromkeys([*first, *self.scores]))}
        self.pieces = list(self.ids)
        self.rank = {tuple(m): k for k, m in enumerate(self.merges)}
        self.longest = max(map(len, self.scores), default=1)

    @classmethod
    def train(cls, df: DataFrame, size: int = 1000, model_type: str = "unigram", character_coverage: float = 0.9995, text_col: str = "text", iterations: int = 2, **options) -> SentencePiece:
        """From the words of the normalised texts. Characters beyond ``character_coverage`` of all are left out and become unknown, or bytes with ``byte_fallback``."""
        empty = cls(model_type, {}, [], **options)
        units = df.select(F.explode(empty._units(F.col(text_col))).alias("word"))
        chars = A.char_counts(units, "word").orderBy(F.desc("n"), "ch").collect()
        total, kept, seen = sum(r.n for r in chars), {}, 0
        for r in chars:
            if seen < character_coverage * total:
                kept[r.ch] = r.n
            seen += r.n
        room = max(0, size - len(empty.ids))
        alphabet = {c: math.log(n / total) for c, n in kept.items()}
        if model_type == "char":
            return cls("char", dict(list(alphabet.items())[:room]), [], **options)
        if model_type == "word":
            words = units.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(room).collect()
            return cls("word", {r.word: math.log(r.n / max(1, total)) for r in words}, [], **options)
        if model_type == "bpe":
            bpe = K.Bpe.train(units.select(F.regexp_replace("word", "^" + MARK, " ").alias(text_col)), max(0, 4 * room), text_col=text_col)
            # Merges that end inside a character have no text: the rest, in order, over characters.
            known, merges = set(alphabet), []
            for a, b in bpe.merges:
                try:
                    pair = tuple(x.decode().replace(" ", MARK) for x in (a, b))
                except UnicodeDecodeError:
                    continue
                if set(pair) <= known and len(known) < room:
                    merges.append(pair)
                    known.add(pair[0] + pair[1])
            return cls("bpe", dict.fromkeys(alphabet, 0.0) | {a + b: -float(k) for k, (a, b) in enumerate(merges)}, merges, **options)
        if model_type != "unigram":
            raise ValueError(f"unknown model type {model_type!r}; there are unigram, bpe, char and word")
        model = K.Unigram.train(units.select(F.col("word").alias(text_col)), max(room, len(alphabet)), iterations, text_col=text_col)
        return cls("unigram", {p: s for p, s in model.scores.items() if all(c in kept for c in p)}, [], **options)

    def normalized(self, text: Column) -> Column:
        return T.squeeze(U.normalize(text, self.normalization) if self.normalization != "identity" else text)

    def _units(self, text: Column) -> Column:
        # Control characters would go with nmt_nfkc, and line ends with them: white space is squeezed first.
        words = T.words(self.normalized(F.regexp_replace(text, T.SPACE, " ")))
        return F.transform(words, lambda w, k: F.when((k > 0) | F.lit(self.add_dummy_prefix), F.concat(F.lit(MARK), w)).otherwise(w))

    def cut(self, word: str, sampled: random.Random | None = None, alpha: float = 0.1) -> list[str]:
        if self.model_type == "word":
            return [word]
        if self.model_type == "char":
            return list(word)
        if self.model_type == "bpe":
            parts = list(word)
            while True:
                found = [(self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank]
                if sampled is not None:
                    found = [x for x in found if sampled.random() >= alpha]
                if not found:
                    return parts
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
        # Sums (or maxima) of all cuts of each prefix, then back from the end.
        best = [0.0] + [-math.inf] * len(word)
        into: list[list[tuple[float, int]]] = [[] for _ in range(len(word) + 1)]
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                s = self.scores.get(word[start:end])
                if s is not None and best[start] > -math.inf:
                    into[end].append((best[start] + (s if sampled is None else alpha * s), start))
            if not into[end]:
                into[end].append((best[end - 1] - 100.0, end - 1))
            top = max(x for x, _ in into[end])
            best[end] = top if sampled is None else top + math.log(sum(math.exp(x - top) for x, _ in into[end]))
        out, end = [], len(word)
        while end:
            if sampled is None:
                start = max(into[end], key=lambda x: (x[0], -x[1]))[1]
            else:
                start = sampled.choices([s for _, s in into[end]], [math.exp(x - best[end]) for x, _ in into[end]])[0]
            out.append(word[start:end])
            end = start
        return out[::-1]

    def _ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte_fallback:
                out += [self.ids[f"<0x{b:02X}>"] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(0)
        return out

    def tokenize(self, text: Column) -> Column:
        return A.by_piece("array<string>", self.cut)(self._units(text))

    def encode(self, text: Column, sample: bool = False, alpha: float = 0.1, seed: int = 42) -> Column:
        """Best cut, or with ``sample`` a cut by chance: unigram cuts with weights score ** alpha, bpe with merges left out at the rate alpha. The chance is that of word and seed."""
        if not sample:
            return A.by_piece("array<int>", lambda w: self._ids(self.cut(w)))(self._units(text))
        return A.by_piece("array<int>", lambda w: self._ids(self.cut(w, random.Random(f"{seed}:{w}"), alpha)))(self._units(text))

    def decode(self, ids: Column) -> Column:
        tokens = {k: p.replace(MARK, " ").encode() for k, p in enumerate(self.pieces)}
        tokens |= dict.fromkeys(range(1, len(_OTHER)), b"")
        tokens |= {self.ids[f"<0x{b:02X}>"]: bytes([b]) for b in range(256)} if self.byte_fallback else {}
        text = A.join_tokens(tokens, _OTHER["unk"].encode())(ids)
        if self.byte_fallback:
            text = F.replace(text, F.lit(MARK), F.lit(" "))
        return F.regexp_replace(text, "^ ", "") if self.add_dummy_prefix else text

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.ids.items()), "token string, id int")

    def save(self) -> str:
        return json.dumps({"kind": "sentencepiece"} | {k: getattr(self, k) for k in ("model_type", "scores", "merges", "normalization", "add_dummy_prefix", "byte_fallback", "user_symbols")})

    @classmethod
    def load(cls, saved: str) -> SentencePiece:
        d = json.loads(saved)
        del d["kind"]
        return cls(**d | {"merges": [tuple(m) for m in d["merges"]], "user_symbols": tuple(d["user_symbols"])})


K.BUILDERS["sentencepiece"] = SentencePiece.train
K.LOADERS["sentencepiece"] = SentencePiece

"""Tokenizers: training is an aggregation in Spark, then at most a loop over aggregated state; encoding maps columns.

Each model is a small driver-side object with ``encode(column)`` and ``decode(column)`` that give columns, and
``vocabulary(spark)`` that gives the table (token, id). Models of one kind encode alike in every session.
"""

from __future__ import annotations

import heapq
import json
import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textquarry.functions import arrow as A, text as T
from textquarry.functions.shared import checkpoint, small
from textquarry.operators import bpe_training
from textquarry.operators.filters import detect_language

SPECIAL = {"pad": "[PAD]", "unk": "[UNK]", "bos": "[BOS]", "eos": "[EOS]", "mask": "[MASK]"}
MAX_WORD = 100


# ---- training aggregates ----


def byte_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return A.byte_counts(df, text_col)


def pretoken_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select(F.explode(T.pretokens(F.col(text_col))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def symbol_counts(pieces: DataFrame) -> DataFrame:
    """(symbol, n) over pieces with counts: distinct pieces are split once."""
    return pieces.select(F.explode(T.byte_values(F.col("piece"))).alias("symbol"), "n").groupBy("symbol").agg(F.sum("n").alias("n"))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """(left, right, n): neighbouring bytes within pieces."""
    return A.pair_counts(pieces)


def pair_scores(pieces: DataFrame) -> DataFrame:
    """(left, right, score): frequency of the pair over the product of its parts' frequencies."""
    s = symbol_counts(pieces)
    return (
        pair_counts(pieces).join(F.broadcast(s.toDF("left", "nl")), "left").join(F.broadcast(s.toDF("right", "nr")), "right")
        .select("left", "right", (F.col("n") / (F.col("nl").cast("double") * F.col("nr"))).alias("score"))
    )  # at most 256 symbols


def wordpiece_candidates(words: DataFrame) -> DataFrame:
    """(token, n) from (word, n): all substrings, with ## inside a word, and once more each single character."""
    w = words.where(F.length("word") <= MAX_WORD)
    starts = w.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    subs = starts.select("word", "n", "s", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("s") + 1)).alias("k"))
    piece = F.substr(F.col("word"), F.col("s"), F.col("k"))
    tokens = subs.select(F.when(F.col("s") > 1, F.concat(F.lit("##"), piece)).otherwise(piece).alias("token"), "n")
    singles = w.select(F.explode(T.chars(F.col("word"))).alias("token"), "n")
    return tokens.union(singles).groupBy("token").agg(F.sum("n").alias("n"))


#: Characters of the candidates that are all counted; tokens that a task holds at once.
SHORT, HELD = 3, 200_000


def _long_candidates(frequent: set[str]) -> Callable:
    """(token, n) of the candidates of over ``SHORT`` characters all of whose stretches of ``SHORT`` are among ``frequent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                last = len(word) - SHORT
                inside = [("##" + word[p : p + SHORT]) in frequent for p in range(last + 1)]
                for s in range(last):
                    if not s and word.startswith("##"):
                        for end in range(SHORT + 3, len(word) + 1):  # as written like a token within words: all of them
                            held[word[:end]] = held.get(word[:end], 0) + n
                        continue
                    if not (inside[s] if s else word[:SHORT] in frequent):
                        continue
                    for p in range(s + 1, last + 1):
                        if not inside[p]:
                            break
                        token = "##" + word[s : p + SHORT] if s else word[: p + SHORT]
                        held[token] = held.get(token, 0) + n
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])

    return run


def wordpiece_vocabulary(df: DataFrame, size: int = 1000, text_col: str = "text", lower: bool = False) -> DataFrame:
    """The ``size`` most frequent candidates; ties: shorter first, then in order of the token.

    A candidate is at most as frequent as any stretch of it: the short ones are counted first, and of the longer ones only those without
    a stretch that is rarer than the last of the ``size`` most frequent short ones.
    """
    t = F.lower(F.col(text_col)) if lower else F.col(text_col)
    words = checkpoint(df.select(F.explode(T.words(t)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))).where(F.length("word") <= MAX_WORD)
    starts = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    # A word that begins with ## has tokens written like those within words: these are counted as far as the others of their text.
    most = F.when((F.col("s") == 1) & F.col("word").startswith("##"), SHORT + 2).otherwise(SHORT)
    subs = starts.select("word", "n", "s", F.explode(F.sequence(F.lit(1), F.least(most, F.length("word") - F.col("s") + 1))).alias("k"))
    piece = F.substr(F.col("word"), F.col("s"), F.col("k"))
    tokens = subs.select(F.when(F.col("s") > 1, F.concat(F.lit("##"), piece)).otherwise(piece).alias("token"), "n")
    singles = words.select(F.explode(T.chars(F.col("word"))).alias("token"), "n")
    short = checkpoint(tokens.union(singles).groupBy("token").agg(F.sum("n").alias("n")))
    top = [r.n for r in short.select("n").orderBy(F.desc("n")).limit(size).collect()]
    least = top[-1] if len(top) == size and size else 0
    frequent = {r.token for r in short.where((F.col("n") >= least) & F.length("token").isin(SHORT, SHORT + 2)).collect()}
    long = words.where(F.length("word") > SHORT).select("word", F.col("n").cast("long")).mapInArrow(_long_candidates(frequent), "token string, n long")
    return short.union(long).groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.length("token"), "token").limit(size)


def unigram_candidates(words: DataFrame, longest: int = 16) -> DataFrame:
    """(piece, n): substrings of the first ``longest`` characters of each segment, and every later character."""
    head = words.select(F.substring("word", 1, longest).alias("h"), F.substr(F.col("word"), F.lit(longest + 1), F.greatest(F.length("word") - longest, F.lit(0))).alias("rest"), "n")
    starts = head.where("h <> ''").select("h", "n", F.explode(F.sequence(F.lit(1), F.length("h"))).alias("s"))
    subs = starts.select("h", "n", "s", F.explode(F.sequence(F.lit(1), F.length("h") - F.col("s") + 1)).alias("k"))
    rest = head.where("rest <> ''").select(F.explode(T.chars(F.col("rest"))).alias("piece"), "n")
    return subs.select(F.substr("h", "s", "k").alias("piece"), "n").union(rest).groupBy("piece").agg(F.sum("n").alias("n"))


def frequency_vocabulary(df: DataFrame, size: int = 1000, pattern: str = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]", text_col: str = "text", special: tuple[str, ...] = tuple(SPECIAL.values())) -> DataFrame:
    """(token, n, id): the most frequent lexer tokens after the special ones; ties in order of the token."""
    c = df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    kept = c.orderBy(F.desc("n"), "token").limit(size - len(special))
    return kept.withColumn("id", (F.row_number().over(W.orderBy(F.desc("n"), "token")) + len(special) - 1).cast("int"))  # at most ``size`` rows


def encode_with_vocabulary(df: DataFrame, vocab: DataFrame, pattern: str, unk_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, token, id): a left join with the vocabulary, unknown tokens get the unknown id."""
    tok = df.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).alias("pos", "token"))
    return tok.join(small(vocab.select("token", "id")), "token", "left").select(id_col, "pos", "token", F.coalesce("id", F.lit(unk_id)).alias("id"))


def merged_vocabulary(children: dict[str, DataFrame], special: tuple[str, ...] = tuple(SPECIAL.values())) -> DataFrame:
    """(label, id): special tokens, then each child's tokens in order, as name:token; a child's special tokens are skipped."""
    from pyspark.sql import Window as W

    spark = next(iter(children.values())).sparkSession
    rows = spark.createDataFrame([(0, k, s) for k, s in enumerate(special)], "child int, rank int, label string")
    for k, (name, vocab) in enumerate(children.items(), 1):
        own = vocab.where(~F.col("token").isin(list(special)))
        rows = rows.union(own.select(F.lit(k).alias("child"), "id", F.concat(F.lit(name + ":"), "token")))
    return rows.select("label", (F.row_number().over(W.orderBy("child", "rank", "label")) - 1).cast("int").alias("id"))


# ---- models ----


def _mapped(kind: str, one: Callable) -> Callable[[Column], Column]:
    def column(c: Column) -> Column:
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else one(x)).astype(object)

        return run(c)

    return column


@dataclass
class ByteLevel:
    """ids 0 to 255 are bytes; special tokens follow while they fit the vocabulary's size."""

    vocab_size: int = 256
    add_prefix_space: bool = False
    special: tuple[str, ...] = tuple(SPECIAL.values())

    def special_ids(self) -> dict[str, int]:
        return {s: 256 + k for k, s in enumerate(self.special) if 256 + k < max(256, self.vocab_size)}

    def encode(self, text: Column, add_special: bool = False) -> Column:
        if self.add_prefix_space:
            text = F.when((text != "") & ~text.startswith(" "), F.concat(F.lit(" "), text)).otherwise(text)
        ids, s = T.byte_values(text), self.special_ids()
        if add_special and "[BOS]" in s and "[EOS]" in s:
            ids = F.concat(F.array(F.lit(s["[BOS]"])), ids, F.array(F.lit(s["[EOS]"])))
        return ids

    def decode(self, ids: Column) -> Column:
        """Special and unknown ids are dropped; bytes that aren't UTF-8 become U+FFFD."""
        pairs = F.transform(F.filter(ids, lambda i: i.between(0, 255)), lambda i: F.lpad(F.hex(i.cast("long")), 2, "0"))
        return F.decode(F.unhex(F.array_join(pairs, "")), "UTF-8")

    def save(self) -> str:
        return json.dumps({"kind": "byte_level", "vocab_size": self.vocab_size, "add_prefix_space": self.add_prefix_space, "special": self.special})

    @classmethod
    def load(cls, saved: str) -> ByteLevel:
        d = json.loads(saved)
        return cls(d["vocab_size"], d["add_prefix_space"], tuple(d["special"]))

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        rows = [(chr(b) if 32 <= b < 127 else f"<byte_{b}>", b) for b in range(256)]
        return spark.createDataFrame([*rows, *self.special_ids().items()], "token string, id int")


@dataclass
class Bpe:
    """Byte-pair encoding: ranks of merges over bytes; ids 0 to 255 are bytes, then merges in order, then special tokens."""

    merges: list[tuple[bytes, bytes]]
    special: tuple[str, ...] = tuple(SPECIAL.values())

    def __post_init__(self):
        self.ids = {bytes([b]): b for b in range(256)}
        for a, b in self.merges:
            self.ids.setdefault(a + b, len(self.ids))
        self.tokens = {i: t for t, i in self.ids.items()}
        self.made = [self.ids[a + b] for a, b in self.merges]
        self.ranks: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(self.merges):
            self.ranks.setdefault((self.ids[a], self.ids[b]), k)

    @classmethod
    def train(cls, df: DataFrame, merges: int = 200, min_frequency: int = 2, mode: str = "exact", text_col: str = "text") -> Bpe:
        """``exact``: classical merges on distinct pieces with counts. ``approx``: pair counts alone, never re-segmented.

        Pieces are counted in Spark, and none is left out but those of one byte, which have no pair. Ties: the pair of least bytes.
        """
        if mode == "approx":
            return cls(_approximate_merges(pair_counts(pretoken_counts(df, text_col)).collect(), merges, min_frequency))
        return cls(bpe_training.train(pretoken_counts(df, text_col).where(F.octet_length("piece") > 1), merges, min_frequency))

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece: the merge of lowest rank first, leftmost among equals; a heap, so a long piece costs n log n."""
        ids = list(piece.encode("utf-8", "surrogatepass"))
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i in range(len(ids) - 1) if (r := self.ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or self.ranks.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < len(ids) and (r := self.ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x))
        return [i for i in ids if i >= 0]

    def encode(self, text: Column) -> Column:
        """Pieces are split natively; only distinct ones are merged, remembered within a task."""
        return A.by_piece("array<int>", self.piece)(T.pretokens(text))

    def decode(self, ids: Column) -> Column:
        return A.join_tokens(self.tokens)(ids)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        rows = [(t.decode("latin-1"), i) for t, i in self.ids.items()]
        return spark.createDataFrame([*rows, *((s, len(rows) + k) for k, s in enumerate(self.special))], "token string, id int")

    def save(self) -> str:
        return json.dumps({"kind": "bpe", "merges": [[a.hex(), b.hex()] for a, b in self.merges], "special": self.special})

    @classmethod
    def load(cls, saved: str) -> Bpe:
        d = json.loads(saved)
        return cls([(bytes.fromhex(a), bytes.fromhex(b)) for a, b in d["merges"]], tuple(d["special"]))


def _approximate_merges(rows: list, merges: int, least: int) -> list[tuple[bytes, bytes]]:
    """Merges from pair counts alone: a merged pair hands its whole count on to the pairs around it."""
    count = {(bytes([r["left"]]), bytes([r["right"]])): r["n"] for r in rows}
    out: list[tuple[bytes, bytes]] = []
    while count and len(out) < merges:
        pair = min(count, key=lambda p: (-count[p], p))
        if count[pair] < least:
            break
        new = pair[0] + pair[1]
        out.append(pair)
        for (a, b), n in list(count.items()):
            if b == pair[0]:
                count[a, new] = count.get((a, new), 0) + n
        for (a, b), n in list(count.items()):
            if a == pair[1]:
                count[new, b] = count.get((new, b), 0) + n
        del count[pair]
    return out


@dataclass
class WordPiece:
    tokens: list[str]
    unk: str = "[UNK]"
    lower: bool = False
    strip_accents: bool = False

    def __post_init__(self):
        self.ids = {t: k for k, t in enumerate(self.tokens)}

    @classmethod
    def train(cls, df: DataFrame, size: int = 1000, text_col: str = "text", special: tuple[str, ...] = tuple(SPECIAL.values()), lower: bool = False) -> WordPiece:
        vocab = wordpiece_vocabulary(df, size, text_col, lower).collect()
        return cls([*special, *(r["token"] for r in vocab if r["token"] not in special)], lower=lower)

    def pieces(self, word: str) -> list[str]:
        """The whole word, else its longest prefixes one after the other; unknown if any part is missing or it is too long."""
        if len(word) > MAX_WORD:
            return [self.unk]
        if word in self.ids:
            return [word]
        out, i = [], 0
        while i < len(word):
            for j in range(len(word), i, -1):
                p = word[i:j] if i == 0 else "##" + word[i:j]
                if p in self.ids:
                    out.append(p)
                    i = j
                    break
            else:
                return [self.unk]
        return out

    def _words(self, text: Column) -> Column:
        return T.words(F.lower(text) if self.lower else text)

    def _pieces(self, word: str) -> list[str]:
        if self.strip_accents:
            word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
        return self.pieces(word)

    def tokenize(self, text: Column) -> Column:
        return A.by_piece("array<string>", self._pieces)(self._words(text))

    def encode(self, text: Column) -> Column:
        unk = self.ids.get(self.unk, 1)
        return A.by_piece("array<int>", lambda w: [self.ids.get(p, unk) for p in self._pieces(w)])(self._words(text))

    def decode(self, ids: Column, glue: bool = True) -> Column:
        """Pieces glued to words; with ``glue=False`` continuations stand apart from a word's first piece."""

        def one(x):
            out: list[str] = []
            for t in (self.tokens[int(i)] for i in x if 0 <= int(i) < len(self.tokens)):
                if t.startswith("##") and out and (glue or out[-1][:2] == "\0\0"):
                    out[-1] += t[2:]
                elif t.startswith("##"):
                    out.append("\0\0" + t[2:])
                else:
                    out.append(t)
            return " ".join(p.removeprefix("\0\0") for p in out)

        return _mapped("string", one)(ids)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, k) for k, t in enumerate(self.tokens)], "token string, id int")

    def save(self) -> str:
        return json.dumps({"kind": "wordpiece", "tokens": self.tokens, "unk": self.unk, "lower": self.lower, "strip_accents": self.strip_accents})

    @classmethod
    def load(cls, saved: str) -> WordPiece:
        d = json.loads(saved)
        return cls(d["tokens"], d["unk"], d["lower"], d.get("strip_accents", False))


@dataclass
class Unigram:
    """Pieces with log probabilities; a segment is cut by Viterbi. A stretch that no pieces cover is one unknown piece."""

    scores: dict[str, float]
    longest: int = 16
    unk: str = "[UNK]"

    def __post_init__(self):
        self.ids = {self.unk: 0} | {p: k + 1 for k, p in enumerate(self.scores)}
        self.tokens = {i: p for p, i in self.ids.items()}

    @classmethod
    def train(cls, df: DataFrame, size: int = 1000, iterations: int = 4, candidates: int = 20_000, text_col: str = "text", evict_frequent: bool = False) -> Unigram:
        """Hard EM: segments (distinct words with counts) are cut with the current scores in Spark, pieces counted again,
        and the least useful dropped until ``size`` is met. Usefulness is count times the loss of log
        likelihood; ``evict_frequent`` drops the pieces of least log p times count instead. Single characters stay."""
        words = checkpoint(df.select(F.explode(T.words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
        found = unigram_candidates(words).orderBy(F.desc("n"), F.length("piece"), "piece")
        counts = {r["piece"]: r["n"] for r in found.limit(candidates).collect()} | {r["piece"]: r["n"] for r in found.where(F.length("piece") == 1).collect()}
        for step in range(iterations):
            total = sum(counts.values())
            model = cls({p: math.log(max(n, 0.5) / total) for p, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))})
            again = words.select(F.explode(A.by_piece("array<string>", model.segment)(F.array("word"))).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n")).collect()
            new = {r["piece"]: r["n"] for r in again if r["piece"] in counts}
            counts = {p: new.get(p, 0) for p in counts if new.get(p, 0) or len(p) == 1}
            excess = len(counts) - size
            if excess > 0:
                worth = (lambda p: model.scores[p] * counts[p]) if evict_frequent else (lambda p: counts[p] * (model.scores[p] - sum(model.scores.get(c, -20.0) for c in p)))
                drop = excess if step == iterations - 1 else max(1, min(len(counts) // 2, excess))
                for p in sorted((p for p in counts if len(p) > 1), key=lambda p: (worth(p), p))[:drop]:
                    del counts[p]
        total = sum(counts.values()) + len(counts)
        return cls({p: math.log((n + 1) / total) for p, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))})

    def segment(self, word: str) -> list[str]:
        best, back = [0.0] + [-math.inf] * len(word), [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                s = self.scores.get(word[start:end])
                if s is not None and best[start] + s > best[end]:
                    best[end], back[end] = best[start] + s, start
            if best[end] == -math.inf:
                # No piece ends here: the character joins an unknown stretch, at a price no known piece pays.
                best[end], back[end] = best[end - 1] - 100.0, end - 1
        out, end = [], len(word)
        while end:
            out.append(word[back[end] : end])
            end = back[end]
        return out[::-1]

    def encode(self, text: Column) -> Column:
        return A.by_piece("array<int>", lambda w: [self.ids.get(p, 0) for p in self.segment(w)])(T.words(text))

    def tokenize(self, text: Column) -> Column:
        return A.by_piece("array<string>", self.segment)(T.words(text))

    def decode(self, ids: Column) -> Column:
        return A.join_tokens({i: t.encode("utf-8", "surrogatepass") for i, t in self.tokens.items()}, self.unk.encode())(ids)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.ids.items()), "token string, id int")

    def save(self) -> str:
        return json.dumps({"kind": "unigram", "scores": self.scores, "longest": self.longest})

    @classmethod
    def load(cls, saved: str) -> Unigram:
        d = json.loads(saved)
        return cls(d["scores"], d["longest"])


@dataclass
class Mixed:
    """Named tokenizers and a router: a column that names the tokenizer of each row."""

    children: dict[str, object]
    router: Callable[[Column], Column]
    default: str

    def route(self, text: Column) -> Column:
        name = self.router(text)
        return F.when(name.isin(list(self.children)), name).otherwise(self.default)

    def encode(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """With columns ``tokenizer`` and ``ids``; the input is read once, and each tokenizer gets its own rows' texts only."""
        routed = df.withColumn("tokenizer", self.route(F.col(text_col)))
        own = lambda n: F.when(F.col("tokenizer") == n, F.col(text_col))
        return routed.withColumn("ids", F.coalesce(*(c.encode(own(n)) for n, c in self.children.items())))

    def decode(self, df: DataFrame, out_col: str = "decoded") -> DataFrame:
        own = lambda n: F.when(F.col("tokenizer") == n, F.col("ids"))
        return df.withColumn(out_col, F.coalesce(*(c.decode(own(n)) for n, c in self.children.items())))

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return merged_vocabulary({n: c.vocabulary(spark) for n, c in self.children.items()}).withColumnRenamed("label", "token")

    def save(self) -> str:
        if not isinstance(self.router, Router):
            raise ValueError("only a Mixed with one of this module's routers can be saved: another router is code")
        return json.dumps({"kind": "mixed", "children": {n: json.loads(c.save()) for n, c in self.children.items()}, "router": self.router.__dict__, "default": self.default})

    @classmethod
    def load(cls, saved: str) -> Mixed:
        d = json.loads(saved)
        r = d["router"]
        return cls({n: load(json.dumps(c)) for n, c in d["children"].items()}, Router(r["kind"], [tuple(x) for x in r["rules"]], r["default"]), d["default"])


@dataclass
class Router:
    """Names the tokenizer of each text: by length, by pattern, or by language."""

    kind: str
    rules: list[tuple]
    default: str

    def __call__(self, text: Column) -> Column:
        out = F.lit(self.default)
        if self.kind == "length":
            for limit, name in sorted(self.rules, reverse=True):
                out = F.when(F.length(text) <= limit, name).otherwise(out)
        elif self.kind == "regex":
            for pattern, name in reversed(self.rules):
                out = F.when(text.rlike(pattern), name).otherwise(out)
        else:
            language = detect_language(text)
            for code, name in reversed(self.rules):
                out = F.when(language == code, name).otherwise(out)
        return out


def length_router(limits: list[tuple[int, str]], default: str) -> Router:
    """The name with the smallest limit that the text's length doesn't pass."""
    return Router("length", limits, default)


def regex_router(rules: list[tuple[str, str]], default: str) -> Router:
    """The name of the first pattern that is found."""
    return Router("regex", rules, default)


def language_router(names: dict[str, str], default: str) -> Router:
    """The name for the text's detected language."""
    return Router("language", list(names.items()), default)


LOADERS: dict[str, type] = {"byte_level": ByteLevel, "bpe": Bpe, "wordpiece": WordPiece, "unigram": Unigram, "mixed": Mixed}
BUILDERS: dict[str, Callable] = {"byte_level": lambda df, **k: ByteLevel(**k), "bpe": Bpe.train, "wordpiece": WordPiece.train, "unigram": Unigram.train}


def build(kind: str, df: DataFrame | None = None, **parameters):
    """Trains a tokenizer by name; further kinds can be put into BUILDERS."""
    if kind not in BUILDERS:
        raise ValueError(f"unknown tokenizer {kind!r}; there are {sorted(BUILDERS)}")
    return BUILDERS[kind](df, **parameters)


def load(saved: str):
    return LOADERS[json.loads(saved)["kind"]].load(saved)

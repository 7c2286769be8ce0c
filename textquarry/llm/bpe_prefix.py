"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a byte string there is exactly one token that ends its BPE encoding, and the encoding of the
string up to that token's start is the encoding of that shorter prefix. So one last token per prefix is the whole
state: the encoding of any prefix is read off by walking back. The last token of a prefix is the one vocabulary entry
that is a suffix of it and that may follow the last token of what is before it, where two tokens may stand side by
side only if encoding their joined bytes gives those two tokens.

A table grows by appending (old entries never change: exact appends) and a change in the middle keeps the entries
before it and recomputes those after it only until the table is as before again, shifted. Text is first split by the
vocabulary's published pattern, as the merges don't cross its pieces; ``PrefixText`` keeps both levels and
supports appends and edits of long texts by re-splitting near the change.

``edit_table`` applies appends and edits to a table of texts, ``append_turns`` appends the turns of conversations one after the other, each re-encoding only what a change can reach.

Defined results: null text gives null ids, the empty text none. Texts of any length are encoded whole, extra columns don't matter (``encode_documents`` keeps them), empty tables
give empty results, and ties don't arise. Ids of a row are those that tiktoken gives for the same file.
Repeated rows are encoded alike. Decoding replaces nothing: bytes that aren't UTF-8 raise no error in
``decode_bytes`` and become U+FFFD in ``decode``. Null ids decode to null, an unknown id is an error (ValueError) on its row's task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.llm._util import fresh, table
from textquarry.llm._vocab import PATTERN, VOCAB_PATH, ranks

#: Pieces remembered per Python process; beyond it the memory starts anew. It only saves time.
CACHE = 400_000

#: Characters outside Latin text; without them the published pattern is the same as _PLAIN, which is faster.
_ODD = re.compile("[^\n\t\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2013-\u2026]")
_PLAIN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Bpe:
    """A byte-level vocabulary: bytes of each token to its rank, which is also its id."""

    def __init__(self, token_ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.pattern = token_ranks, regex.compile(pattern)
        self.bytes = {i: b for b, i in token_ranks.items()}
        self.longest = max(map(len, token_ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for b, i in token_ranks.items():
            self.machine.add_word(b.decode("latin-1"), (i, len(b)))
        self.machine.make_automaton()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._halves:
            b = self.bytes[token]
            got = None
            if len(b) > 1:
                parts = self._merge(b, token)
                got = (parts[0], parts[1]) if len(parts) == 2 else None
            self._halves[token] = got
        return self._halves[token]

    def _merge(self, b: bytes, below: int) -> list[int]:
        """Plain BPE of a short byte string with the merges of ranks under ``below``."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while True:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, joined, are encoded as these two tokens."""
        key = left << 24 | right
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            got = self._fits[key] = self._fits_slow(left, right)
        return got

    def _fits_slow(self, a: int, b: int) -> bool:
        # Undo merges from the latest on: at no time may the two tokens facing each other be ones that an earlier merge joins.
        limit = 1 << 31
        while True:
            joined = self.ranks.get(self.bytes[a] + self.bytes[b])
            if joined is not None and joined < limit and self.halves(joined) == (a, b):
                return False
            ha, hb = self.halves(a), self.halves(b)
            if ha is None and hb is None:
                return True
            if hb is None or (ha is not None and a > b):
                limit, a = a, ha[1]
            else:
                limit, b = b + 1, hb[0]

    def extend(self, data: bytes, last: list[int]) -> None:
        """Appends to ``last`` the last token of each prefix of ``data`` that is longer than those it covers."""
        known, fits = self._fits.get, self.fits
        begin = max(0, len(last) + 1 - self.longest)
        # Matches come by their end, the longest first, and mostly that one is right.
        for end, (t, size) in self.machine.iter(data.decode("latin-1"), begin):
            if end == len(last):
                at = end - size
                if at < 0:
                    last.append(t)
                else:
                    ok = known(last[at] << 24 | t)
                    if ok or (ok is None and fits(last[at], t)):
                        last.append(t)
        if len(last) != len(data):
            raise ValueError("the vocabulary lacks a byte")

    def walk(self, last: list[int]) -> list[int]:
        out, end, width = [], len(last), self.bytes
        while end:
            t = last[end - 1]
            out.append(t)
            end -= len(width[t])
        out.reverse()
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.walk(last)

    def _remember(self, piece: str) -> tuple[int, ...]:
        if len(self._cache) >= CACHE:
            self._cache.clear()
        got = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= 64:
            self._cache[piece] = got
        return got

    def split(self, text: str) -> list[str]:
        plain = self.pattern.pattern == PATTERN and not _ODD.search(text)
        return (_PLAIN if plain else self.pattern).findall(text)

    def encode(self, text: str) -> list[int]:
        get, remember = self._cache.get, self._remember
        return list(chain.from_iterable([get(p) or remember(p) for p in self.split(text)]))

    def decode_bytes(self, ids: list[int]) -> bytes:
        try:
            return b"".join(map(self.bytes.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"unknown token id {e}") from None

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str = VOCAB_PATH, pattern: str = PATTERN) -> Bpe:
    return Bpe(ranks(path), pattern)


class PrefixText:
    """A text with the prefix tables of its pieces: appends and edits re-encode only what they can change."""

    def __init__(self, model: Bpe, text: str = ""):
        self.model, self.pieces, self.tables, self.work, self.stands = model, [], [], 0, 0
        self.append(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        return [t for last in self.tables for t in self.model.walk(last)]

    def append(self, more: str) -> None:
        self.edit(sum(map(len, self.pieces)), 0, more)

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replaces ``remove`` characters from ``at`` on by ``insert``."""
        # A piece depends on the text from its start to one character past its end (look-ahead), so all
        # pieces that end before the change by two characters or more stand. White space before them may have
        # been split by look-ahead alone: go back one piece further.
        k = pos = 0
        while k < len(self.pieces) and pos + len(self.pieces[k]) + 1 < at:
            pos += len(self.pieces[k])
            k += 1
        if k:
            k -= 1
            pos -= len(self.pieces[k])
        self.stands = k  # pieces that this change leaves as they are
        tail, total = self.pieces[k:], "".join(self.pieces[k:])
        changed = total[: at - pos] + insert + total[at - pos + remove :]
        # Starts of old pieces after the change, in the new text's positions: there the old split is met again.
        again, p = {}, 0
        for j, piece in enumerate(tail):
            if p >= at - pos + remove:
                again[p - remove + len(insert)] = k + j
            p += len(piece)
        pieces, tables, done = [], [], False
        for m in self.model.pattern.finditer(changed):
            if m.start() > at - pos + len(insert) and m.start() in again:
                j = again[m.start()]
                self.pieces[k:] = pieces + self.pieces[j:]
                self.tables[k:] = tables + self.tables[j:]
                done = True
                break
            old = self.pieces[k + len(pieces)] if k + len(pieces) < len(self.pieces) else ""
            data = m.group().encode("utf-8", "surrogatepass")
            same, before = 0, old.encode("utf-8", "surrogatepass")
            while same < min(len(before), len(data)) and before[same] == data[same]:
                same += 1
            last = self.tables[k + len(pieces)][:same] if same else []
            self.work += len(data) - same
            self.model.extend(data, last)
            pieces.append(m.group())
            tables.append(last)
        if not done:
            self.pieces[k:], self.tables[k:] = pieces, tables


def encode_table(docs: DataFrame, vocab_path: str = VOCAB_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, exact, ids): the ids of each text; ``exact`` tells that decoding them gave its bytes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(vocab_path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else model.encode(t) for t in texts]
                exact = [None if t is None else model.decode_bytes(x) == t.encode("utf-8", "surrogatepass") for t, x in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else len(x) for x in ids], pa.int32()), pa.array(exact, pa.bool_()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "exact", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_tokens int, exact boolean, ids array<int>")


def edit_table(docs: DataFrame, vocab_path: str = VOCAB_PATH, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(doc_id, text, ids, encoded_bytes): each text after its edits, an array of structs (at, remove, insert) applied in order.

    ``encoded_bytes`` counts the bytes that the edits had to encode anew. Null edits (or null fields: at the end, nothing, nothing) change nothing, places beyond
    the text's end are its end; a null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(vocab_path)
        for b in batches:
            rows = []
            for i, t, edits in zip(*(b.column(k).to_pylist() for k in range(3))):
                if t is None:
                    rows.append((i, None, None, None))
                    continue
                x = PrefixText(model, t)
                x.work = 0
                for e in edits or []:
                    if e is not None:
                        size = sum(map(len, x.pieces))
                        at = size if e["at"] is None else min(max(e["at"], 0), size)
                        x.edit(at, min(max(e["remove"] or 0, 0), size - at), e["insert"] or "")
                rows.append((i, x.text, x.ids(), x.work))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int64()))], ["doc_id", "text", "ids", "encoded_bytes"])

    edits = F.col(edits_col).cast("array<struct<at:int,remove:int,insert:string>>")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), edits.alias("e")).mapInArrow(run, "doc_id long, text string, ids array<int>, encoded_bytes long")


def append_turns(turns: DataFrame, vocab_path: str = VOCAB_PATH, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """(conv_id, turn, kept, new_ids, n_tokens): how the ids of a conversation go on with each turn.

    The ids after a turn are the first ``kept`` of those before it and then ``new_ids``. Conversations stream through sorted tasks: a task holds one conversation's pieces at a
    time. Rows with a null id are left out; a null text adds the separator only; equal turn numbers are in order of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(vocab_path)
        now, x, sizes = None, None, []
        for b in batches:
            rows = []
            for i, turn, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                if x is None or i != now:
                    now, x, sizes = i, PrefixText(model), []
                    more = t or ""
                else:
                    more = separator + (t or "")
                x.append(more)
                kept = sum(sizes[: x.stands])
                new = [model.walk(last) for last in x.tables[x.stands :]]
                sizes[x.stands :] = map(len, new)
                rows.append((i, turn, kept, [k for ids in new for k in ids], sum(sizes)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32()))], ["conv_id", "turn", "kept", "new_ids", "n_tokens"])

    x = turns.select(F.col(id_col).cast("long").alias("i"), F.col(order_col).cast("long").alias("o"), F.col(text_col).cast("string").alias("t")).where("i is not null")
    return x.repartition("i").sortWithinPartitions("i", "o", "t").mapInArrow(run, "conv_id long, turn long, kept int, new_ids array<int>, n_tokens int")


def decode_table(encoded: DataFrame, vocab_path: str = VOCAB_PATH, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with its ids decoded into ``text_col``."""

    @F.pandas_udf("string")
    def text(ids):
        model = bpe(vocab_path)
        return ids.map(lambda x: None if x is None else model.decode(list(x))).astype(object)

    return encoded.withColumn(text_col, text(F.col(ids_col)))


def encode_documents(docs: DataFrame, vocab_path: str = VOCAB_PATH, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with its columns and the ids (``ids_col``, renamed if the table has it) of its texts."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        model = bpe(vocab_path)
        return texts.map(lambda t: model.encode(t) if isinstance(t, str) else None).astype(object)

    return docs.withColumn(fresh(docs, ids_col), ids(F.col(text_col).cast("string")))


def op8_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"))


def bpe_prefix_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append_turns(table(spark, sf_dir, "conversations"))


QUERIES = {"op8_bpe_prefix": op8_bpe_prefix, "bpe_prefix_conversations": bpe_prefix_conversations}
ORACLES: dict[str, str] = {}

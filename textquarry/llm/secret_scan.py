"""Secret scans by token efficiency.

A vocabulary trained on text spends few characters per token on random strings. Candidates are unbroken ASCII runs of
at least ``min_length`` characters that mix letters and digits (or upper and lower case in an unusual way); their
characters per token under a tiktoken vocabulary are compared with ``max_chars_per_token``. Excluded first, as known
digests and identifiers: UUIDs; runs of only digits; e-mail addresses and the schemes, hosts and paths of links (but
not user-info, parameters, fragments and assigned values that stand in one run with them); and strings of a
digest's exact length in hexadecimal digits when a label such as sha256, md5, commit, etag or checksum stands before
them, or when no assignment to a key stands before them at all (a bare digest). A hexadecimal string that is assigned
to a key (token = "...") is a secret whatever its length.

What stands before a string (a label or a key with its sign) is looked for in the ``_BEFORE`` characters there: both end at the string, so more tells nothing.

Defined results: null and empty texts have no hits. Whole texts are scanned, however long. Each occurrence is a hit, so a string
that repeats gives several rows, and repeated rows give theirs each; ties don't arise. Extra columns don't matter. Empty tables give empty results. ``redact_secrets`` puts ``[SECRET]`` in place of each hit, keeps all rows and
columns, and leaves null texts null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.llm._util import table
from textquarry.llm._vocab import VOCAB_PATH, encoding

MIN_LENGTH, MAX_CHARS_PER_TOKEN, _BEFORE = 16, 2.3, 48


@lru_cache(maxsize=8)
def _strings(min_length: int) -> tuple[re.Pattern, re.Pattern]:
    """(unbroken runs, the strings in them) of at least so many characters."""
    n = f"{{{max(1, min_length)},}}"
    return re.compile(r"[A-Za-z0-9+/_.=~@:%&?#-]" + n, re.ASCII), re.compile(r"[A-Za-z0-9+/_.~-]" + n + "={0,2}", re.ASCII)


_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX = re.compile(r"[0-9a-fA-F]+")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_DIGEST_LABEL = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5|blake2[bs]?|digest|checksum|integrity|commit|revision|etag|fingerprint|object|tree|parent|hash)[\"'\s:=_-]{0,4}$", re.I)
_ASSIGNED = re.compile(r"[A-Za-z_][\w.-]*[\"']?\s{0,3}(?:=|:=|:|=>)\s{0,3}[\"'`]?$|(?:bearer|basic|token|secret|password|passwd|key)\s{1,3}[\"'`]?$", re.I)
_PLACE = re.compile(r"^(?:https?|ftp|s3|git|file|mailto|data|urn)[:/]|^www\.|@[\w-]+\.|://|^[\w.-]+\.(?:com|org|net|io|gov|edu|html?|php|js|css|png|jpe?g|gif|pdf|json|xml|py|java)\b", re.I)


#: The parts of a run that name a place. A path ends at a query or fragment; a value assigned inside it ends at the next slash.
_LINK = re.compile(r"(?P<scheme>(?:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*)?://)(?:(?P<user>[^/?#]*)@)?(?P<host>[^/?#@=&]*)(?P<path>(?:/[^?#]*)?)", re.I)
_NESTED_LINK = re.compile(r"(?P<scheme>(?:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*)?://)(?:(?P<user>[^/?#&]*)@)?(?P<host>[^/?#@=&]*)(?P<path>(?:/[^?#&]*)?)", re.I)
_OPAQUE = re.compile(r"(?:(?<=[=&?#])|^)(?:https?|ftp|s3|git|file|mailto|data|urn)[:/](?!/)(?P<path>[^?#&]*)", re.I)
_NAME = re.compile(r"(?:(?<=[=&?#])|^)(?:www\.[\w.-]+|[\w.-]+\.(?:com|org|net|io|gov|edu|html?|php|js|css|png|jpe?g|gif|pdf|json|xml|py|java)\b[\w.~+%-]*)(?::\d{1,5}(?![\w.-]))?(?P<path>(?:/[^?#&]*)?)", re.I)
_MAILBOX = re.compile(r"(?<![\w.+%~-])(?P<local>[\w.+%~-]*)@[\w-]+\.[\w.-]*(?::\d{1,5}(?![\w.-]))?(?P<path>(?:/[^?#&]*)?)")
_GIT = re.compile(r"git@[\w.-]+:[^?#&=]*", re.I)
_MAIL_LABEL = re.compile(r"(?:^|[^a-z])(?:e-?mail|mail|mailto|to|cc|bcc|from|author|contact|by|sender|user):$", re.I)
_VALUE = re.compile(r"=([^/?#&=]+)")
_PASSWORD = re.compile(r":([^:/?#@&=]+)@(?=[\w-])")


def _tested(run: str) -> list[tuple[int, int]]:
    """The spans of a run that are no scheme, host, path or mailbox."""
    if not _PLACE.search(run):
        return [(0, len(run))]
    named = bytearray(len(run))

    def exclude(a: int, b: int) -> None:
        named[a:b] = b"\1" * (b - a)

    def path(m: re.Match) -> None:
        exclude(*m.span("path"))
        for v in _VALUE.finditer(run, *m.span("path")):  # an assigned value is none of its names
            if not _PLACE.search(v[1]):
                named[v.start(1) : v.end(1)] = bytes(v.end(1) - v.start(1))

    for place in (_NAME, _OPAQUE, _MAILBOX):
        for m in place.finditer(run):
            exclude(m.start(), m.start("path"))
            path(m)
    for m in _GIT.finditer(run):
        exclude(*m.span())
    # Last the links: what they say of user-info and parameters holds against the others.
    at, query = 0, min((k for k in map(run.find, "?=") if k >= 0), default=len(run))
    while m := (_NESTED_LINK if at > query else _LINK).search(run, at):
        exclude(m.start("scheme"), m.end("scheme"))
        exclude(*m.span("host"))
        path(m)
        if m["user"]:
            named[m.start("user") : m.end("user")] = bytes(len(m["user"]))
        at = m.end()
        if "://" in m["path"]:  # a link inside the path
            at = m.start("path")
    for m in _PASSWORD.finditer(run):
        if not _MAIL_LABEL.search(run[max(0, m.start(1) - 16) : m.start(1)]):
            named[m.start(1) : m.end(1)] = bytes(len(m[1]))
    spans, a = [], 0
    for b, x in enumerate(named + b"\1"):
        if x:
            if b > a:
                spans.append((a, b))
            a = b + 1
    return spans


#: Scripts that put no space between words, or none before their particles: a string beside their letters is not part of a longer word.
_UNSPACED = re.compile("[฀-࿿က-႟ᄀ-ᇿក-៿ᥐ-᧟ᨠ-᪯⺀-⿿々-㆏ㆠ-ㇿ㐀-䶿一-鿿ꧠ-꧿ꩠ-꫟가-퟿豈-﫿ｦ-ￜ\U0001b000-\U0001b16f\U00020000-\U0003ffff]")


def _joins(c: str) -> bool:
    return c.isalnum() and not _UNSPACED.match(c)


def _random_looking(s: str, min_length: int) -> bool:
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    if letters + digits < min_length or not letters:
        return False
    if digits >= 2:
        return True
    turns = sum(a.islower() and b.isupper() for a, b in zip(s, s[1:]))
    return turns >= 3 and len(s) >= min_length + 4


def find_secrets(text: str | None, enc, min_length: int = MIN_LENGTH, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, float]]:
    """(start, end, characters per token) of each secret; offsets count code points."""
    found = []
    if not text or len(text) < min_length:
        return found
    runs, strings = _strings(min_length)
    for run in runs.finditer(text):
        whole = run.group()
        # A run that goes on into other letters is part of a longer word, not a string of its own.
        if (run.start() and _joins(text[run.start() - 1])) or (run.end() < len(text) and _joins(text[run.end()])):
            continue
        for m in (m for a, b in _tested(whole) for m in strings.finditer(whole, a, b)):
            s = m.group().rstrip(".~-/")
            if len(s) < min_length or not _random_looking(s, min_length) or _UUID.fullmatch(s) or s.count("/") > 3 and s.startswith("/"):
                continue
            start = run.start() + m.start()
            before = text[max(0, start - _BEFORE) : start]
            if _HEX.fullmatch(s) and len(s) in _DIGEST_LENGTHS and (_DIGEST_LABEL.search(before) or not _ASSIGNED.search(before)):
                continue
            rate = len(s) / len(enc.encode_ordinary(s))
            if rate <= max_chars_per_token:
                found.append((start, start + len(s), rate))
    return found


def scan_secrets(docs: DataFrame, vocab_path: str = VOCAB_PATH, min_length: int = MIN_LENGTH, max_chars_per_token: float = MAX_CHARS_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, chars_per_token, secret) of every hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocab_path)
        for b in batches:
            rows = [(i, s, e, round(r, 6), t[s:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, e, r in find_secrets(t, enc, min_length, max_chars_per_token)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string()))], ["doc_id", "start", "end", "chars_per_token", "secret"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, start int, end int, chars_per_token double, secret string")


def redact_secrets(docs: DataFrame, vocab_path: str = VOCAB_PATH, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret replaced by ``[SECRET]``; ``length_col``, if there, is counted anew."""

    @F.pandas_udf("string")
    def clean(texts):
        enc = encoding(vocab_path)

        def one(t):
            if not isinstance(t, str):
                return None
            out, last = [], 0
            for s, e, _ in find_secrets(t, enc):
                out += [t[last:s], "[SECRET]"]
                last = e
            return "".join([*out, t[last:]]) if last else t

        return texts.map(one).astype(object)

    out = docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES: dict[str, str] = {}

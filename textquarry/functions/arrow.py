"""Arrow functions over whole batches: for what Spark has no fast expression, and without a Python call for each row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Distinct pieces that a task remembers, and their characters and results.
REMEMBERED, REMEMBERED_SIZE = 200_000, 4_000_000
#: List items, and bytes of text, that a function works on at once: what it holds beside its batch is bounded by them.
ITEMS, BYTES = 1 << 19, 1 << 22


def _lists(lengths: np.ndarray, values: pa.Array, null: pa.Array) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=null)


def _lengths(v: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def in_parts(v: pa.Array, f: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``f`` of a batch's texts or lists, applied to some rows at a time: ``BYTES`` of text or ``ITEMS`` of lists, or one row that has more."""
    text = pa.types.is_string(v.type)
    size = pc.fill_null(pc.binary_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64) if text else _lengths(v)
    edges = _edges(size, BYTES if text else ITEMS)
    if len(edges) <= 2:
        return f(v)
    return pa.concat_arrays([f(v.slice(a, b - a)) for a, b in zip(edges, edges[1:])])


def _edges(size: np.ndarray, most: int) -> list[int]:
    """Where rows of these sizes are cut, so that no part of more than one row has over ``most``."""
    ends, edges = np.cumsum(size), [0]
    while edges[-1] < len(size):
        start = edges[-1]
        before = ends[start - 1] if start else 0
        edges.append(max(start + 1, int(np.searchsorted(ends, before + most, side="right"))))
    return edges


def by_piece(kind: str, one: Callable[[str], list]) -> Callable[[Column], Column]:
    """A function of columns of string arrays: each piece gives a list, a row gets those of its pieces one after the other.

    ``one`` is called once for each distinct piece of a batch that the task doesn't remember.
    """
    item = {"array<int>": pa.int32(), "array<string>": pa.string()}[kind]

    def column(c: Column) -> Column:
        memory: dict[str, list] = {}
        held = 0

        def part(v: pa.Array) -> pa.Array:
            nonlocal held
            pieces = v.flatten().dictionary_encode()
            lists = []
            for w in pieces.dictionary.to_pylist():
                got = memory.get(w)
                if got is None:
                    if len(memory) >= REMEMBERED or held >= REMEMBERED_SIZE:
                        memory.clear()
                        held = 0
                    got = memory[w] = one(w)
                    held += len(w) + len(got)
                lists.append(got)
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            known = pa.array([x for got in lists for x in got], item)
            at = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            counts = n[at]
            ends = np.concatenate(([0], np.cumsum(counts)))
            place = np.repeat((np.cumsum(n) - n)[at] - ends[:-1], counts) + np.arange(ends[-1])
            rows = np.concatenate(([0], np.cumsum(_lengths(v))))
            return _lists(np.diff(ends[rows]), known.take(pa.array(place)), v.is_null())

        @F.arrow_udf(kind)
        def run(v: pa.Array) -> pa.Array:
            return in_parts(v, part)

        return run(c)

    return column


def join_tokens(tokens: dict[int, bytes], unknown: bytes = b"") -> Callable[[Column], Column]:
    """A function of columns of ids: the tokens' bytes put together; what isn't UTF-8 becomes U+FFFD."""
    size = max(tokens, default=-1) + 1

    def column(c: Column) -> Column:
        def part(v: pa.Array, table: pa.Array) -> pa.Array:
            ids = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            parts = table.take(pa.array(np.where((ids >= 0) & (ids < size), ids, size)))
            joined = pc.binary_join(_lists(_lengths(v), parts, v.is_null()), b"")
            try:
                return joined.cast(pa.string())
            except pa.ArrowInvalid:
                return pa.array([None if x is None else x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())

        @F.arrow_udf("string")
        def run(v: pa.Array) -> pa.Array:
            table = pa.array([*(tokens.get(i, unknown) for i in range(size)), unknown], pa.binary())
            return in_parts(v, lambda some: part(some, table))

        return run(c)

    return column


def known_or(tokens: Column, known: list[str], other: str) -> Column:
    """Arrays of strings with what isn't among ``known`` replaced; natively, by a hash set in the plan."""
    return F.transform(tokens, lambda t: F.when(t.isin(known), t).otherwise(other))


def _raw(a: pa.Array) -> np.ndarray:
    """The bytes of all strings of an array."""
    a = a.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def byte_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(byte, n): each task counts its bytes, 256 rows of it are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for b in batches:
            if b.num_rows:
                raw = _raw(b.column(0).drop_null())
                for k in range(0, len(raw), BYTES):
                    n += np.bincount(raw[k : k + BYTES], minlength=256)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["byte", "n"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def char_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(ch, n): each task counts its code points; at most one row for each is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0x110000, np.int64)
        for b in batches:
            raw = _raw(b.column(0).drop_null()) if b.num_rows else np.zeros(0, np.uint8)
            at = 0
            while at < len(raw):
                end = min(len(raw), at + BYTES)
                while end < len(raw) and raw[end] & 0xC0 == 0x80 and end > at + 1:  # not inside a character
                    end -= 1
                got = np.bincount(np.frombuffer(raw[at:end].tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32))
                n[: len(got)] += got
                at = end
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in at], pa.string()), pa.array(n[at])], ["ch", "n"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """(left, right, n) of neighbouring bytes in (piece, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for b in batches:
            if b.num_rows:
                text, n = b.column(0).cast(pa.large_binary()), b.column(1).to_numpy()
                size = pc.binary_length(text).to_numpy().astype(np.int64)
                edges = _edges(size, BYTES)
                for x, y in zip(edges, edges[1:]):
                    raw, piece = _raw(text.slice(x, y - x)), np.repeat(np.arange(x, y), size[x:y])
                    inside = piece[1:] == piece[:-1]
                    code = (raw[:-1].astype(np.int64) << 8 | raw[1:])[inside]
                    np.add.at(total, code, n[piece[:-1][inside]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at >> 8).astype(np.int32)), pa.array((at & 255).astype(np.int32)), pa.array(total[at])], ["left", "right", "n"])

    found = pieces.select("piece", F.col("n").cast("long")).where("piece is not null").mapInArrow(run, "left int, right int, n long")
    return found.groupBy("left", "right").agg(F.sum("n").alias("n"))


def diversity(df: DataFrame, words: Column, id_col: str) -> DataFrame:
    """(id, total, types, once, x, y) of each row's words: counts n, x the sum of n log2(n), y of n (n - 1). Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            edges = _edges(_lengths(whole.column(1)), ITEMS)
            for a, z in zip(edges, edges[1:]):
                b = whole.slice(a, z - a)
                lists = b.column(1)
                row = np.repeat(np.arange(b.num_rows), _lengths(lists))
                word = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pair, n = np.unique(row << 32 | word, return_counts=True)
                row = pair >> 32
                add = lambda w: np.bincount(row, weights=w, minlength=b.num_rows)  # noqa: B023,E731
                total = add(n)
                keep = np.flatnonzero(total)
                cols = [total.astype(np.int64), add(np.ones(len(n))).astype(np.int64), add(n == 1).astype(np.int64), add(n * np.log2(n)), add(n * (n - 1.0))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), *(pa.array(c[keep]) for c in cols)], [id_col, "total", "types", "once", "x", "y"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, words.alias("w")).mapInArrow(run, f"`{id_col}` {kind}, total long, types long, once long, x double, y double")

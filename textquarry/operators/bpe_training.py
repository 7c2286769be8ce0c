"""Merges of byte-pair encoding, on distinct pieces with counts, as flat arrays of symbols.

Where the pieces fit ``DRIVER_BYTES`` the driver does all merges; beyond that the pieces stay a table: each round counts
pairs in the tasks, the driver sees these counts only, and the tasks apply the merges that no other merge of the
round can overtake. The table is written packed, and again after every ``SNAPSHOT`` merges; between, the tasks repeat the merges since. Both give the same merges.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textquarry.functions.shared import checkpoint

#: Bytes of distinct pieces up to which the driver merges by itself; it holds about 40 times as many.
DRIVER_BYTES = 1 << 23
#: Symbols of a packed row, merges after which the table is written again, symbols up to which pairs are counted in a table.
PACKED, SNAPSHOT, TABLE = 1 << 20, 32, 2048
_END = -1


def flat(pieces: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all pieces, _END after each; the count of each symbol's piece)."""
    raw = pieces.cast(pa.large_binary())
    size = pc.binary_length(raw).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    out = np.full(len(data) + len(size), _END, np.int32)
    weight = np.repeat(n, size + 1)
    ends = np.cumsum(size + 1) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = data
    return out, weight


def pairs_of(symbols: np.ndarray, weight: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(left << 32 | right, summed counts) of neighbouring symbols, of all places or of those given."""
    left, right = (symbols[:-1], symbols[1:]) if at is None else (symbols[at], symbols[at + 1])
    ok = (left != _END) & (right != _END)
    code, place = np.unique(left[ok].astype(np.int64) << 32 | right[ok], return_inverse=True)
    n = (weight[:-1] if at is None else weight[at])[ok]
    return code, np.rint(np.bincount(place, weights=n, minlength=len(code))).astype(np.int64)


def all_pairs(symbols: np.ndarray, weight: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """``pairs_of`` all places, by a table for few kinds of symbols: nothing is sorted, and some places at a time."""
    if kinds > TABLE:
        return pairs_of(symbols, weight)
    total = np.zeros(kinds * kinds, np.int64)
    for k in range(0, len(symbols) - 1, PACKED):
        left, right = symbols[k : k + PACKED], symbols[k + 1 : k + PACKED + 1]
        left = left[: len(right)]
        ok = (left != _END) & (right != _END)
        total += np.rint(np.bincount(left[ok].astype(np.int64) * kinds + right[ok], weights=weight[k : k + len(right)][ok], minlength=kinds * kinds)).astype(np.int64)
    at = np.flatnonzero(total)
    return (at // kinds) << 32 | at % kinds, total[at]


def apply(symbols: np.ndarray, weight: np.ndarray, left: int, right: int, new: int, changed=None) -> tuple[np.ndarray, np.ndarray]:
    """The pair merged from left to right in every piece. ``changed(codes, counts)`` is told which pairs go and come."""
    at = np.flatnonzero((symbols[:-1] == left) & (symbols[1:] == right))
    if left == right and len(at):
        # In a run of equal symbols every second place is a merge.
        run = np.concatenate(([True], np.diff(at) != 1))
        at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
    if not len(at):
        return symbols, weight
    if changed is not None:
        # Every pair that touches a merged place goes, and those of the new places come.
        merged = np.zeros(len(symbols) + 2, bool)
        merged[at + 1] = merged[at + 2] = True
        code, n = pairs_of(symbols, weight, np.flatnonzero(merged[1:-2] | merged[2:-1]))
        changed(code, -n)
    symbols = symbols.copy()
    symbols[at] = new
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    here = np.zeros(len(symbols), bool)
    here[at] = True
    symbols, weight, here = symbols[keep], weight[keep], here[keep]
    if changed is not None:
        code, n = pairs_of(symbols, weight, np.flatnonzero(here[:-1] | here[1:]))
        changed(code, n)
    return symbols, weight


class Symbols:
    """The bytes of each symbol; merges that give the same bytes are one symbol."""

    def __init__(self):
        self.of = [bytes([b]) for b in range(256)]
        self.number = {t: k for k, t in enumerate(self.of)}
        self.merges: list[tuple[bytes, bytes]] = []

    def add(self, left: int, right: int) -> int:
        self.merges.append((self.of[left], self.of[right]))
        both = self.of[left] + self.of[right]
        if both not in self.number:
            self.number[both] = len(self.of)
            self.of.append(both)
        return self.number[both]


def on_driver(pieces: pa.Table, merges: int, least: int) -> list[tuple[bytes, bytes]]:
    return _on_driver(*flat(pieces.column("piece").combine_chunks(), pieces.column("n").to_numpy()), merges, least)


def _on_driver(symbols: np.ndarray, weight: np.ndarray, merges: int, least: int) -> list[tuple[bytes, bytes]]:
    s = Symbols()
    counts: dict[int, int] = {}
    heap: list[tuple] = []

    def changed(codes: np.ndarray, n: np.ndarray) -> None:
        for c, k in zip(codes.tolist(), n.tolist()):
            counts[c] = now = counts.get(c, 0) + k
            if now > 0:
                heapq.heappush(heap, (-now, s.of[c >> 32], s.of[c & 0xFFFFFFFF], c))

    changed(*all_pairs(symbols, weight, 256))
    while heap and len(s.merges) < merges:
        n, _, _, code = heapq.heappop(heap)
        if counts.get(code, 0) != -n:
            continue
        if -n < max(1, least):
            break
        symbols, weight = apply(symbols, weight, code >> 32, code & 0xFFFFFFFF, s.add(code >> 32, code & 0xFFFFFFFF), changed)
    return s.merges


_SCHEMA = "size long, symbols binary, n binary"


def _merged(b: pa.RecordBatch, steps: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The symbols and weights of each packed row, after the merges."""
    for text, n in zip(b.column(1), b.column(2)):
        symbols, weight = _unpacked(text.as_py(), n.as_py())
        for left, right, new in steps:
            symbols, weight = apply(symbols, weight, left, right, new)
        yield symbols, weight


def distributed(state: DataFrame, merges: int, least: int) -> list[tuple[bytes, bytes]]:
    """The same merges; the packed pieces stay in the tasks, and one row for each distinct pair reaches the driver in a round."""
    s, since = Symbols(), []
    while len(s.merges) < merges:

        def pairs(batches: Iterator[pa.RecordBatch], steps=tuple(since), kinds=len(s.of)) -> Iterator[pa.RecordBatch]:
            total: dict[int, int] = {}
            for b in batches:
                for symbols, weight in _merged(b, steps):
                    for code, n in zip(*(x.tolist() for x in all_pairs(symbols, weight, kinds))):
                        total[code] = total.get(code, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

        rows = state.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, least)).toArrow()
        counts = {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(rows.column("pair").to_numpy(), rows.column("n").to_numpy())}
        batch = []
        for (left, right), n in sorted(counts.items(), key=lambda x: (-x[1], s.of[x[0][0]], s.of[x[0][1]])):
            if len(s.merges) >= merges:
                break
            # A merge that comes before makes new pairs, none more frequent than the pairs it touches: this one may go along only if
            # it has no symbol of theirs and is more frequent than all of those.
            if batch and any({left, right} & {a, b} or n <= most for a, b, _, most in batch):
                break
            most = max((m for (a, b), m in counts.items() if (b == left or a == right) and (a, b) != (left, right)), default=0)
            known = len(s.of)
            batch.append((left, right, s.add(left, right), most))
            if len(s.of) == known:  # a symbol that there was before: its pairs' counts grow
                break
        if not batch:
            break
        since += [b[:3] for b in batch]
        if len(since) >= SNAPSHOT and len(s.merges) < merges:

            def written(batches: Iterator[pa.RecordBatch], steps=tuple(since)) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for symbols, weight in _merged(b, steps):
                        yield _packed(symbols, weight)

            state, since = checkpoint(state.mapInArrow(written, _SCHEMA)), []
    return s.merges


def _packed(symbols: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """One row: its bytes unpacked, the symbols in two bytes each where they fit, and one count for each piece, compressed."""
    ends = symbols == _END
    kind = "<u2" if symbols.max(initial=0) < 0xFFFF else "<i4"
    data = zlib.compress(symbols.astype(kind).tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([len(symbols) - int(ends.sum())], pa.int64()), pa.array([kind.encode() + data], pa.binary()), pa.array([zlib.compress(weight[ends].astype("<i8").tobytes(), 1)], pa.binary())], ["size", "symbols", "n"])


def _unpacked(data: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = data[:3].decode()
    symbols = np.frombuffer(zlib.decompress(data[3:]), kind).astype(np.int32)
    if kind == "<u2":
        symbols[symbols == 0xFFFF] = _END
    ends = np.flatnonzero(symbols == _END)
    return symbols, np.repeat(np.frombuffer(zlib.decompress(n), "<i8"), np.diff(ends, prepend=-1))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if b.num_rows:
            held.append(flat(b.column(0), b.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= PACKED:
            yield _packed(*map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield _packed(*map(np.concatenate, zip(*held)))


def train(pieces: DataFrame, merges: int, least: int, driver_bytes: int = DRIVER_BYTES) -> list[tuple[bytes, bytes]]:
    state = checkpoint(pieces.where("piece is not null").select("piece", F.col("n").cast("long")).mapInArrow(_pack, _SCHEMA))
    size = state.agg(F.sum("size")).first()[0] or 0
    if size <= driver_bytes:
        rows = [_unpacked(r.symbols, r.n) for r in state.collect()]
        return _on_driver(*map(np.concatenate, zip(*rows)), merges, least) if rows else []
    return distributed(state, merges, least)

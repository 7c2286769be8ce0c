"""SimHash near-dedup by anchor-point covering.

Fingerprints have ``BLOCKS`` blocks of 23 bits. The anchors of a block are the 4096 words of the perfect binary Golay
code: every 23-bit string is within covering radius 3 of exactly one of them. A fingerprint is a *home* member of
that anchor, and is replicated to every anchor within 3 + ``block_threshold`` of it (one: 5.3 anchors on average).
If two fingerprints differ in at most ``block_threshold`` bits of some block, the anchor that is home to one is
reached by the other, so comparing, per anchor, home members with all members finds each such pair; whenever the
distance over all blocks is below BLOCKS * (block_threshold + 1) there is such a block. Pairs further apart, up to
``max_distance``, are found with a probability that falls slowly (tests hold the recall against brute force).

Documents whose words (lower case, without punctuation) are the same, in the same order, are copies: they
collapse to the smallest id before any fingerprint is compared, whatever their number. Fingerprints are of the
weighted words (square root of their count). Found pairs are verified by the Jaccard similarity of their word
pairs, estimated from the smallest ``SKETCH`` hashes of each. Groups are the connected components; the document with
the smallest id stays.

Defined results: rows with null id or null text are in no group and stay. Texts without any word (empty,
only signs) are copies only of texts that are equal to them character by character. Rows that repeat an id are one document:
its first text in order counts, and its rows go or stay together. Extra columns pass through. Texts are read
whole. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.llm._util import U64, alnum_spans, checkpoint, code_points, fresh, keyed_text, mix64, mul_powers, stored, table, word_hashes

BLOCKS, BITS, SKETCH = 8, 23, 64
MAX_DISTANCE, BLOCK_THRESHOLD, MIN_JACCARD = 36, 1, 0.45
_GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(for each syndrome the error pattern of least weight, all words of the code)."""

    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ (_GOLAY << (bit - 11)), x)
        return x

    bits = [1 << i for i in range(23)]
    errors = np.array([0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])], dtype=np.int64)
    table_ = np.zeros(2048, dtype=np.int64)
    table_[syndrome(errors)] = errors
    all_high = np.arange(4096, dtype=np.int64) << 11
    return table_, all_high ^ syndrome(all_high)


@lru_cache(maxsize=4)
def reach(block_threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome's error pattern e: the code words within 3 + threshold of e, as (offsets, words).

    The anchors of x = home ^ e are home ^ w for those w: the code is linear.
    """
    errors, words = golay()
    near = [words[np.bitwise_count(words ^ e) <= 3 + block_threshold] for e in errors]
    return np.cumsum([0, *map(len, near)]), np.concatenate(near)


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low and the high 12 bits: the syndrome is linear, so two lookups give it."""
    out = []
    for shift in (0, 12):
        x = np.arange(4096 if not shift else 2048, dtype=np.int64) << shift
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ (_GOLAY << (bit - 11)), x)
        out.append(x)
    return out[0], out[1]


def syndrome(x: np.ndarray) -> np.ndarray:
    low, high = _syndromes()
    return low[x & 4095] ^ high[x >> 12]


def _bits(h: np.ndarray) -> np.ndarray:
    """192 pseudo-random bits of each hash, as -1 and 1."""
    words = np.stack([mix64(h ^ U64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in (1, 2, 3)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8)[:, : BLOCKS * BITS] * 2 - 1


_PAIR = np.uint64(0xD6E8FEB86659FD93)


def fingerprint(text: str) -> tuple[bytes, list[int], list[int]]:
    """(content key of 16 bytes, the blocks of the fingerprint, the sketch of its word pairs)."""
    return _fingerprint_words(word_hash_sequence(text), text)


def word_hash_sequence(text: str) -> np.ndarray:
    cp = code_points(text.lower())
    return word_hashes(cp, *alnum_spans(cp))


def _fingerprint_words(h: np.ndarray, text: str) -> tuple[bytes, list[int], list[int]]:
    if not len(h):
        h = word_hashes(cp := code_points(text), np.zeros(1, np.int64), np.full(1, len(cp)))
        h = mix64(h ^ U64(0x5851F42D4C957F2D))
    with np.errstate(over="ignore"):
        key = b"".join(int(mix64(np.array([np.sum((h ^ U64(s)) * mul_powers(b, len(h)), dtype=U64)], U64))[0]).to_bytes(8, "little") for s, b in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)))
        pairs = mix64(h[:-1] * _PAIR + h[1:]) if len(h) > 1 else h
    ordered = np.sort(h)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    distinct, counts = ordered[first], np.diff(first, append=len(ordered))
    total = np.zeros(BLOCKS * BITS, dtype=np.float32)
    for i in range(0, len(distinct), 4096):
        total += np.sqrt(counts[i : i + 4096]).astype(np.float32) @ _bits(distinct[i : i + 4096]).astype(np.float32)
    on = (total > 0).reshape(BLOCKS, BITS)
    return key, (on @ (1 << np.arange(BITS))).tolist(), _smallest(pairs >> U64(32))


def _smallest(x: np.ndarray) -> list[int]:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))][:SKETCH].astype(np.int64).tolist()


_FP_SCHEMA = "id long, key binary, fp array<int>, sketch array<long>"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, key, fp, sketch) of a table (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.list_(pa.int64()))], ["id", "key", "fp", "sketch"])

    return docs.mapInArrow(run, _FP_SCHEMA)


def _replicate(block_threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors, _ = golay()
        offsets, words = reach(block_threshold)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            fps = b.column(1).flatten().to_numpy().astype(np.int64).reshape(len(ids), BLOCKS)
            packed = pa.array([r.tobytes() for r in np.packbits((fps[:, :, None] >> np.arange(BITS)) & 1, axis=None).reshape(len(ids), -1)], pa.binary())
            for k in range(BLOCKS):
                s = syndrome(fps[:, k])
                home = fps[:, k] ^ errors[s]
                n = offsets[s + 1] - offsets[s]
                row = np.repeat(np.arange(len(ids)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[s], n)
                w = words[at]
                anchor = home[row] ^ w
                yield pa.RecordBatch.from_arrays([pa.array(k << 12 | anchor >> 11, pa.int32()), pa.array(w == 0), pa.array(ids[row]), packed.take(pa.array(row))], ["anchor", "home", "id", "fp"])

    return run


def _anchor_counts(block_threshold: int):
    """(anchor, n): how many rows each anchor will have, counted by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors, _ = golay()
        offsets, words = reach(block_threshold)
        total = np.zeros(BLOCKS << 12, np.int64)
        for b in batches:
            fps = b.column(0).flatten().to_numpy().astype(np.int64).reshape(b.num_rows, BLOCKS)
            for k in range(BLOCKS):
                s = syndrome(fps[:, k])
                n = offsets[s + 1] - offsets[s]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[s], n)
                anchor = np.repeat(fps[:, k] ^ errors[s], n) ^ words[at]
                total += np.bincount(k << 12 | anchor >> 11, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["anchor", "n"])

    return run


def _compare(max_distance: int):
    """Of one anchor (or a block of one): home members of the block's first part with all members of its second."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, home = t.column("id").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        left_side, right_side = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        raw = np.frombuffer(b"".join(t.column("fp").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        pad = np.zeros((len(ids), -raw.shape[1] % 8), dtype=np.uint8)
        fp = np.ascontiguousarray(np.hstack([raw, pad])).view(U64)
        left, right = [], []
        step = max(1, 4_000_000 // max(1, len(right_side)))
        for i in range(0, len(left_side), step):
            part = left_side[i : i + step]
            d = np.zeros((len(part), len(right_side)), dtype=np.uint8)
            for c in range(fp.shape[1]):
                d += np.bitwise_count(fp[part, c][:, None] ^ fp[right_side, c][None, :])
            a, b = np.nonzero(d <= max_distance)
            a, b = part[a], right_side[b]
            # Of two home members each pair comes up twice: it counts once.
            keep = (ids[a] != ids[b]) & (~home[b] | (ids[a] < ids[b]))
            left.append(ids[a[keep]])
            right.append(ids[b[keep]])
        l, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.table({"a": np.minimum(l, r), "b": np.maximum(l, r)})

    return run


#: Members of an anchor from which it is compared in blocks, each of which is a task's work.
SPLIT = 16_384


def candidate_pairs(fps: DataFrame, max_distance: int = MAX_DISTANCE, block_threshold: int = BLOCK_THRESHOLD) -> DataFrame:
    """Distinct (a, b), a < b, of (id, fp) rows that an anchor brings together within ``max_distance``.

    The members of an anchor with more than ``SPLIT`` are spread over parts by their ids; the home members of each part meet the
    members of each part in a block. Every pair of the anchor is compared, in one block.
    """
    rows = fps.select("id", "fp").mapInArrow(_replicate(block_threshold), "anchor int, home boolean, id long, fp binary")
    counts = fps.select("fp").mapInArrow(_anchor_counts(block_threshold), "anchor int, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    large = checkpoint(counts.where(F.col("n") > SPLIT).select("anchor", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")))  # at most 8 * 4096 rows
    if large.isEmpty():
        rows = rows.withColumns({"left": F.col("home"), "right": F.lit(True), "block": F.lit(0)})
    else:
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        other = F.sequence(F.lit(0), F.col("parts") - 1)
        as_ = lambda left: lambda q: F.struct((F.col("part") * F.col("parts") + q if left else q * F.col("parts") + F.col("part")).alias("block"), F.lit(left).alias("left"), F.lit(not left).alias("right"))
        whole = F.array(F.struct(F.lit(0).alias("block"), F.col("home").alias("left"), F.lit(True).alias("right")))
        places = F.when(F.col("parts").isNull(), whole).otherwise(F.concat(F.transform(other, as_(False)), F.when(F.col("home"), F.transform(other, as_(True))).otherwise(F.array().cast("array<struct<block:int,left:boolean,right:boolean>>"))))
        rows = rows.join(F.broadcast(large), "anchor", "left").withColumn("part", part).withColumn("place", F.explode(places)).select("anchor", "home", "id", "fp", "place.*")
    return rows.groupBy("anchor", "block").applyInArrow(_compare(max_distance), "a long, b long").distinct()


def _jaccard(a: str, b: str):
    """Jaccard similarity estimated from two sketches of smallest hashes."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def components(edges: DataFrame) -> DataFrame:
    """(id, group) of every id in (a, b): the smallest id that can be reached from it.

    Alternates large-star and small-star steps until nothing changes: O(log n) rounds. A node's smallest neighbour is an
    aggregate that is joined to its edges: a node with any number of neighbours is never one row.
    """
    edges = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(first.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpoint(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("group"))
    return members.union(edges.select(F.col("b").alias("id"), F.col("b").alias("group")).distinct())


def near_duplicate_groups(docs: DataFrame, max_distance: int = MAX_DISTANCE, block_threshold: int = BLOCK_THRESHOLD, min_jaccard: float = MIN_JACCARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id) of every document in a group of two or more; the one with doc_id = keep_id stays."""
    fps = fingerprints(keyed_text(docs, id_col, text_col)).groupBy("id").agg(F.min(F.struct("key", "fp", "sketch")).alias("x")).select("id", "x.*")
    fps = stored(fps)
    first = checkpoint(fps.groupBy("key").agg(F.min(F.struct("id", "fp", "sketch")).alias("x"), F.count("*").alias("n")))
    reps = first.select("x.*")
    copied = first.where("n > 1").select("key", F.col("x.id").alias("rep"))
    pairs = candidate_pairs(reps, max_distance, block_threshold)
    s = reps.select("id", "sketch")
    near = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").where(_jaccard("sa", "sb") >= min_jaccard)
    groups = components(near)
    copies = checkpoint(fps.select("id", "key").join(copied, "key").select("rep", "id"))
    near_ids = groups.toDF("rep", "group")
    return (
        copies.union(groups.select("id", "id")).distinct().toDF("rep", "doc_id").join(near_ids, "rep", "left")
        .select("doc_id", F.coalesce("group", "rep").alias("keep_id")).distinct()
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` without the members of groups that aren't the one that stays; all columns and other rows as they are."""
    name = fresh(docs, "near_id")
    out = near_duplicate_groups(docs, id_col=id_col, text_col=text_col, **parameters).where("doc_id <> keep_id").select(F.col("doc_id").alias(name))
    return docs.join(out, F.col(id_col).cast("long") == F.col(name), "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}

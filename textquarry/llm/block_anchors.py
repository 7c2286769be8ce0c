"""Substring dedup by fixed-block anchors.

1. Every document is cut into words. Its non-overlapping blocks of ``block`` words are the reference blocks; every
   rolling window of as many words probes them. Windows travel as packed arrays, bucketed by hash: four bytes of hash
   and about two of place each. A window that equals a block elsewhere is a hit.
2. A repeat of at least ``min_words`` >= 2 * block words holds a whole block of either copy, so it has a hit. Only
   around hits, windows of ``min_words`` words are hashed anew (64 bits) and brought together: the hits are
   extended word by word through every such window that occurs again anywhere.
3. Per document, neighbouring windows that repeat the same place of the same partner join to exact repeats.

The partner of a window is its first occurrence (by id and position), that of the first occurrence the second. No
occurrence is dropped, however often a passage repeats, and the work is linear in the windows. So a span is maximal only with
respect to first occurrences: where a passage's parts occur first in different documents it is reported as several spans, and a longer repeat with
a later occurrence is not. Every repeated word is covered all the same.

Words are runs without white space (single characters in scripts without spaces), so a repeat is exact up to
white space. Offsets and lengths count words.

Defined results: rows with null id or text and texts shorter than ``min_words`` words have no repeats (a text repeats
itself too if a passage occurs in it twice). Rows that repeat an id are one document: the first text in order counts.
Extra columns don't matter. Empty tables give empty results. Whole texts are read.

The number of buckets follows spark.sql.shuffle.partitions. The second pass over the texts is narrowed by a Bloom
filter of constant size (``FILTER_BITS``): with more documents it lets more through, and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.llm._util import U64, Powers, checkpoint, code_points, fresh, keyed_text, mix64, table, word_hashes, word_spans

BLOCK, MIN_WORDS = 25, 50
FILTER_BITS = 1 << 25
_CHUNK = 1_000_000  # characters hashed at once
_WORDS = Powers(0xD1342543DE82EF95 | 1)
_PACKED = "bucket int, ids binary, counts binary, pos binary, hash binary"


def batch_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    cp = code_points("\n".join(texts))
    starts, ends = word_spans(cp)
    first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return word_hashes(cp, starts, ends), np.diff(np.searchsorted(starts, first), append=len(starts))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 are missing."""
    if len(h) < k:
        return np.zeros(0, U64)
    p, q = _WORDS.get(len(h) + 1)
    with np.errstate(over="ignore"):
        s = np.concatenate((np.zeros(1, U64), np.cumsum(h * p[: len(h)], dtype=U64)))
        return mix64((s[k:] - s[:-k]) * q[: len(h) - k + 1])


def windows(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the text, position) of all windows that lie in one text."""
    h, counts = batch_words(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    pos = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    w = window_hashes(h, k)
    ok = doc[: len(w)] == doc[k - 1 :] if len(w) else np.zeros(0, bool)
    return w[ok], doc[: len(w)][ok], pos[: len(w)][ok]


def _planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of the numbers, byte by byte: high zero bytes then compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _numbers(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(n, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :n] = raw.T
    return out.view("<u8").ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of signed numbers as small unsigned ones."""
    d = np.diff(x.astype(np.int64), prepend=0)
    return ((d << 1) ^ (d >> 63)).view(U64)


def _unsteps(x: np.ndarray) -> np.ndarray:
    d = (x >> U64(1)).view(np.int64) ^ -(x & U64(1)).view(np.int64)
    return np.cumsum(d)


def _pack(bucket: np.ndarray, ids: np.ndarray, pos: np.ndarray, values: list[tuple[np.ndarray, int]]) -> Iterator[tuple]:
    """Per bucket: ids in runs, differences of positions, planes of the values (of 8-byte ones, of their differences).

    Rows should be in order of id and position: then differences are small.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, ids, pos = bucket[order], ids[order], pos[order]
    values = [(v[order], n) for v, n in values]
    edges = np.concatenate((np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), [len(bucket)])) if len(bucket) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        i, p = ids[a:b], pos[a:b]
        new = np.concatenate(([True], (i[1:] != i[:-1]) | (p[1:] <= p[:-1])))
        at = np.flatnonzero(new)
        delta = np.where(new, p, np.diff(p, prepend=0))
        yield (int(bucket[a]), _planes(_steps(i[at]), 8), _planes(np.diff(at, append=b - a), 4), _planes(delta, 4), *(_planes(v[a:b], n) if n < 8 else _planes(_steps(v[a:b]), 8) for v, n in values))


def _unpack(ids: bytes, counts: bytes, pos: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = _numbers(counts, 4).astype(np.int64)
    delta = _numbers(pos, 4).astype(np.int64)
    total = np.cumsum(delta)
    first = np.cumsum(counts) - counts
    return np.repeat(_unsteps(_numbers(ids, 8)), counts), total - np.repeat(total[first] - delta[first], counts)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "bucket" else pa.binary()) for c, n in zip(cols, names)], names)


_NAMES = ["bucket", "ids", "counts", "pos", "hash"]


def _chunks(ids: list, texts: list) -> Iterator[tuple[np.ndarray, list[str]]]:
    i, size, a = 0, 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= _CHUNK:
            yield np.array(ids[a : i + 1], np.int64), texts[a : i + 1]
            a, size = i + 1, 0
    if a < len(texts):
        yield np.array(ids[a:], np.int64), texts[a:]


def _all_windows(block: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            w, i, p = (np.concatenate(x) for x in zip(*held))
            held.clear()
            # A task's documents in order of id, so that runs of ids are short and positions ascend.
            return _rows(list(_pack(((w >> U64(32)) % U64(buckets)).astype(np.int64), i, p, [(w & U64(0xFFFFFFFF), 4)])), _NAMES)

        for b in batches:
            for ids, texts in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, doc, pos = windows(texts, block)
                held.append((w, ids[doc], pos))
                size += len(w)
                if size >= 2_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _gather(t: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(*_unpack(a, c, p), _numbers(h, n)) for a, c, p, h in zip(*(t.column(x).to_pylist() for x in _NAMES[1:]))]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _find_hits(block: int, doc_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        ids, pos, h = _gather(t, 4)
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        has = np.bincount(group, weights=pos[order] % block == 0) > 0
        hit = np.zeros(len(h), bool)
        hit[order] = (has & (np.bincount(group) > 1))[group]
        ids, pos = ids[hit], pos[hit]
        order = np.lexsort((pos, ids))
        ids, pos = ids[order], pos[order]
        return pa.Table.from_batches([_rows(list(_pack(_doc_bucket(ids, doc_buckets), ids, pos, [])), _NAMES[:4])])

    return run


def _doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(U64)) % U64(n)).astype(np.int64)


def _bits(ids: np.ndarray) -> np.ndarray:
    h = mix64(ids.astype(np.int64).view(U64) ^ U64(0x2545F4914F6CDD1D))
    return np.stack([h % U64(FILTER_BITS), (h >> U64(32)) % U64(FILTER_BITS)])


def _id_filter(hits: DataFrame):
    """A Bloom filter of FILTER_BITS bits of the documents that have hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            for ids in b.column(0).to_pylist():
                bits[_bits(_unsteps(_numbers(ids, 8))).ravel()] = True
        words = np.packbits(bits, bitorder="little").view("<i4")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at], pa.int32())], ["at", "word"])

    rows = hits.select("ids").mapInArrow(run, "at int, word int").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(FILTER_BITS // 32, "<i4")
    words[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return hits.sparkSession.sparkContext.broadcast(words.view(np.uint8))


def _extend(block: int, min_words: int, buckets: int):
    """Packed windows of min_words words that hold a hit, of the documents and hits of one bucket of ids."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        held = []
        if docs.num_rows and hits.num_rows:
            parts = [_unpack(*r) for r in zip(*(hits.column(x).to_pylist() for x in _NAMES[1:4]))]
            hid, hpos = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((hpos, hid))
            hid, hpos = hid[order], hpos[order]
            wanted = set(np.unique(hid).tolist())
            rows = {}
            for i, t in zip(docs.column("id").to_pylist(), docs.column("text").to_pylist()):
                if i in wanted and (i not in rows or t < rows[i]):
                    rows[i] = t
            for ids, texts in _chunks(list(rows), list(rows.values())):
                w, doc, pos = windows(texts, min_words)
                if not len(w):
                    continue
                # Of each text: which windows start within [hit - (min_words - block), hit].
                counts = np.bincount(doc, minlength=len(texts))
                begin = np.cumsum(counts) - counts
                mark = np.zeros(len(w) + 1, np.int64)
                for k, i in enumerate(ids):
                    if counts[k]:
                        a, b = np.searchsorted(hid, [i, i + 1])
                        p = hpos[a:b]
                        lo = np.maximum(p - (min_words - block), 0)
                        hi = np.minimum(p, counts[k] - 1)
                        ok = lo <= hi
                        np.add.at(mark, begin[k] + lo[ok], 1)
                        np.add.at(mark, begin[k] + hi[ok] + 1, -1)
                near = np.cumsum(mark)[:-1] > 0
                held.append((w[near], ids[doc[near]], pos[near]))
        out = []
        if held:
            w, i, p = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((p, i))
            out = list(_pack(((w[order] >> U64(40)) % U64(buckets)).astype(np.int64), i[order], p[order], [(w[order], 7)]))
        return pa.Table.from_batches([_rows(out, _NAMES)])

    return run


def _partners(doc_buckets: int):
    """Of the windows of one hash bucket: those that occur again, each with its partner, packed by document."""

    def run(t: pa.Table) -> pa.Table:
        ids, pos, h = _gather(t, 7)
        order = np.lexsort((pos, ids, h))
        ids, pos, h = ids[order], pos[order], h[order]
        first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        size = np.diff(start, append=len(h))
        partner = np.repeat(start, size)
        partner[start] = np.minimum(start + 1, len(h) - 1)
        again = np.repeat(size > 1, size)
        rid, rpos = ids[partner][again], pos[partner][again]
        ids, pos = ids[again], pos[again]
        order = np.lexsort((pos, ids))
        ids, pos, rid, rpos = (x[order] for x in (ids, pos, rid, rpos))
        # Neighbours mostly share the partner and the diagonal, whose differences are then 0.
        return pa.Table.from_batches([_rows(list(_pack(_doc_bucket(ids, doc_buckets), ids, pos, [(rid, 8), (rpos - pos, 8)])), [*_NAMES[:4], "rid", "diag"])])

    return run


def _maximal(min_words: int):
    def run(t: pa.Table) -> pa.Table:
        parts = [(*_unpack(a, c, p), _unsteps(_numbers(r, 8)), _unsteps(_numbers(d, 8))) for a, c, p, r, d in zip(*(t.column(x).to_pylist() for x in ("ids", "counts", "pos", "rid", "diag")))]
        ids, pos, rid, diag = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((pos, diag, rid, ids))
        ids, pos, rid, diag = ids[order], pos[order], rid[order], diag[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (rid[1:] != rid[:-1]) | (diag[1:] != diag[:-1]) | (pos[1:] != pos[:-1] + 1)
        at = np.flatnonzero(new)
        n = np.diff(at, append=len(ids)) + min_words - 1
        return pa.table({"doc_id": ids[at], "start_word": pos[at], "n_words": n, "other_id": rid[at], "other_start": pos[at] + diag[at]})

    return run


def repeats(docs: DataFrame, block: int = BLOCK, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, other_id, other_start): maximal exact repeats of at least ``min_words`` words.

    For each document all places of it that occur again, there or elsewhere, each with a partner.
    """
    if min_words < 2 * block:
        raise ValueError("min_words must be at least 2 * block: a shorter repeat may hold no whole block")
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = keyed_text(docs, id_col, text_col)
    hits = checkpoint(d.mapInArrow(_all_windows(block, buckets), _PACKED).groupBy("bucket").applyInArrow(_find_hits(block, buckets), "bucket int, ids binary, counts binary, pos binary"))
    bloom = _id_filter(hits)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bloom.value
        for b in batches:
            ids = b.column(0).to_numpy()
            at = _bits(ids).astype(np.int64)
            keep = ((words[at >> 3] >> (at & 7)) & 1).all(axis=0) if len(ids) else np.zeros(0, bool)
            b = b.filter(pa.array(keep.astype(bool)))
            yield pa.RecordBatch.from_arrays([pa.array(_doc_bucket(b.column(0).to_numpy(), buckets), pa.int32()), b.column(0), b.column(1)], ["bucket", "id", "text"])

    near = d.mapInArrow(narrowed, "bucket int, id long, text string")
    candidates = near.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_extend(block, min_words, buckets), _PACKED)
    found = candidates.groupBy("bucket").applyInArrow(_partners(buckets), "bucket int, ids binary, counts binary, pos binary, rid binary, diag binary")
    return found.groupBy("bucket").applyInArrow(_maximal(min_words), "doc_id long, start_word long, n_words long, other_id long, other_start long")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` without those words that repeat an earlier place (smaller id, or earlier in the text); other rows unchanged."""
    later = repeats(docs, id_col=id_col, text_col=text_col, **parameters).where("other_id < doc_id or (other_id = doc_id and other_start < start_word)")
    a, spans = fresh(docs, "cut_id"), fresh(docs, "cut_spans")
    cuts = later.groupBy(F.col("doc_id").alias(a)).agg(F.sort_array(F.collect_list(F.array("start_word", "n_words"))).alias(spans))

    @F.pandas_udf("string")
    def cut(texts, lists):
        def one(t, s):
            if not isinstance(t, str) or s is None:
                return t
            starts, ends = word_spans(code_points(t))
            out, last = [], 0
            for a, n in sorted(map(tuple, s)):
                if a + n <= len(starts) and ends[a + n - 1] > last:
                    out.append(t[last : max(last, starts[a])])
                    last = int(ends[a + n - 1])
            return "".join([*out, t[last:]])

        return texts.combine(lists, one).astype(object)

    joined = docs.join(cuts, F.col(id_col).cast("long") == F.col(a), "left")
    return joined.withColumn(text_col, cut(F.col(text_col).cast("string"), F.col(spans))).select(*docs.columns)


def op10_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op10_block_anchors": op10_block_anchors}
ORACLES: dict[str, str] = {}

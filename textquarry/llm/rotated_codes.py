"""Embedding near-dedup by randomised-rotation binary codes.

Vectors are scaled to length 1 and rotated at random. A vector's code is the signs of its rotated coordinates, read as
a unit vector; with it goes the correction factor f, the inner product of code and vector. For another rotated vector q
(kept with 4 bits a coordinate, rounded at random so that the mean is right), <code, q> / f is an unbiased estimate of
the cosine, and its error is below EPSILON * sqrt((1 - f^2) / (f^2 (D - 1))) with high probability. Of a candidate pair
both directions are averaged. Where the lower bound reaches the threshold the pair is accepted as it is, where the upper
bound misses it the pair is dropped; only the pairs in between have their vectors joined in and the cosine computed.

Candidates are vectors that agree in all bits of a band; bands are slices of the codes of several independent rotations. A
band's bits follow the logarithm of the number of vectors, so that the vectors of a band stay as few at any size, and the number of
bands follows from them: a pair at ``min_cosine`` is met with probability RECALL (51,000 vectors: 24 bands of 14 bits), one at 0.97 with over 0.999.
Every vector is compared with all others of its bands; no band is cut. A band of more than SPLIT vectors (a dense cluster) is
compared in blocks: its vectors are spread over parts by their ids, and each pair of parts is a task.

Equal vectors are one class, whose id is the smallest of theirs; only classes are compared. The result of the query has
one row a vector: its class, with how many other classes that class is linked (cosine of at least ``min_cosine``), and the
smallest id that can be reached by links.

Defined results: null ids, null or empty embeddings, and vectors with a null, a NaN, an infinity or only zeros are
left out. Vectors of different length never match. Rows that repeat an id are one vector, the smallest. Ties need no rule:
every link counts. Vectors may have any length, and are compared whole. Extra columns don't matter. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.llm._util import U64, checkpoint, mix64, small, table
from textquarry.llm.simhash_anchors import components

#: Least cosine of a link; share of the pairs at just that cosine that some band brings together; vectors of a band from which it is split.
MIN_COSINE, RECALL, SPLIT, EPSILON, SEED = 0.9, 0.945, 4096, 3.0, 7


def band_plan(n: int, min_cosine: float = MIN_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bands, bits of a band) for n vectors: bits follow log2(n), bands the recall."""
    bits = min(30, max(8, round(math.log2(max(n, 1))) - 2))
    agree = (1 - math.acos(min(1.0, min_cosine)) / math.pi) ** bits
    return (max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1), bits


@lru_cache(maxsize=16)
def rotations(dim: int, n: int, seed: int) -> np.ndarray:
    """n random orthogonal matrices."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


#: Length of vectors up to which a rotation is a random orthogonal matrix; longer ones are turned by signs and Hadamard transforms.
MATRIX_DIM = 1024


def padded(dim: int) -> int:
    """Coordinates of a rotated vector."""
    return dim if dim <= MATRIX_DIM else 1 << (dim - 1).bit_length()


def rotate(x: np.ndarray, k: int, n: int, seed: int) -> np.ndarray:
    """The vectors after rotation k of n."""
    rows, dim = x.shape
    if dim <= MATRIX_DIM:
        return x @ rotations(dim, n, seed)[k].T
    size = padded(dim)
    y = np.zeros((rows, size))
    y[:, :dim] = x
    rng = np.random.default_rng([seed, dim, k])
    for _ in range(3):
        y = (y * rng.choice((-1.0, 1.0), size)).reshape(rows, -1)
        h = 1
        while h < size:
            y = y.reshape(rows, -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
            h *= 2
        y = y.reshape(rows, size) / np.sqrt(size)
    return y


def encode(r: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sign bits, correction factors, 4-bit coordinates, their lowest value, their step) of rotated unit vectors."""
    dim = r.shape[1]
    f = np.abs(r).sum(axis=1) / np.sqrt(dim)
    low = r.min(axis=1, keepdims=True)
    step = np.maximum((r.max(axis=1, keepdims=True) - low) / 15, 1e-12)
    with np.errstate(over="ignore"):
        u = (mix64(ids.astype(np.int64).view(U64)[:, None] * U64(0x9E3779B97F4A7C15) + np.arange(dim).astype(U64)[None, :]) >> U64(40)).astype(np.float64) / (1 << 24)
    q = np.clip(np.floor((r - low) / step + u), 0, 15).astype(np.uint8)
    return r > 0, f, q, low[:, 0], step[:, 0]


def bounds(f: np.ndarray, dim: int) -> np.ndarray:
    f = np.clip(f, 1e-6, 1)
    return EPSILON * np.sqrt((1 - f * f) / (f * f * max(1, dim - 1)))


_PARTS = 1 << 15
_FEW, _PAIRS = 64, 100_000  # vectors of a band up to which its pairs are listed; pairs taken at once


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, unit vectors) of a batch."""
    lists = b.column(1)
    dims = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    for dim in np.unique(dims):
        same = np.flatnonzero(dims == dim)
        for rows in np.array_split(same, -(-len(same) * int(dim) // 1_000_000)):  # at most a million coordinates at once
            x = values[at[rows][:, None] + np.arange(dim)].astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small numbers leave the range
            yield int(dim), b.column(0).to_numpy()[rows], x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(x: np.ndarray, bands: int, bits: int, seed: int) -> Iterator[np.ndarray]:
    """Band by band, the key of each vector: its bits, the band's number and the dimension's hash."""
    dim = padded(x.shape[1])
    width = min(bits, dim)
    per = dim // width
    salt = mix64(np.array([x.shape[1]], U64))[0]
    for band in range(bands):
        rot, part = divmod(band, per)
        if not part:
            r = rotate(x, 1 + rot, 1 + -(-bands // per), seed)
        v = r[:, part * width : (part + 1) * width] > 0
        with np.errstate(over="ignore"):
            yield mix64((v @ (1 << np.arange(width))).astype(U64) + U64(band << 32) + salt).view(np.int64)


def _band_keys(bands: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, x in _by_dim(b):
                for key in _keys(x, bands, bits, seed):
                    found, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["band", "n"])

    return run


def _bands(bands: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, ids, x in _by_dim(b):
                sign, f, q, low, step = encode(rotate(x, 0, 1, seed), ids)
                code = np.hstack([np.packbits(sign, axis=1), q[:, 0::2] << 4 | np.pad(q[:, 1::2], ((0, 0), (0, q.shape[1] % 2))), np.stack([f, low, step], axis=1).astype("<f4").view(np.uint8)])
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                for key in _keys(x, bands, bits, seed):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(ids), dim, np.int32)), pa.array(ids), codes], ["band", "dim", "id", "code"])

    return run


def _estimate(min_cosine: float):
    """Pairs of the bands (or blocks of bands) of one bucket. Those of few vectors are taken together, pair by pair; large ones as matrices."""

    def run(t: pa.Table) -> pa.Table:
        band, ids, block = t.column("band").to_numpy(), t.column("id").to_numpy(), t.column("block").to_numpy()
        dim = padded(t.column("dim")[0].as_py())
        order = np.lexsort((ids, block, band))
        band, ids, block = band[order], ids[order], block[order]
        first_part = t.column("part").to_numpy()[order] == block // _PARTS
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        start = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (block[1:] != block[:-1]))))
        size = np.diff(start, append=len(ids))
        nb = -(-dim // 8)
        out: list[list[np.ndarray]] = [[], [], [], []]

        def vectors(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(signs over the correction factor, coordinates, error bounds)."""
            c = code[rows]
            f, low, step = np.ascontiguousarray(c[:, -12:]).view("<f4").T
            sign = np.unpackbits(c[:, :nb], axis=1)[:, :dim].astype(np.float32) * 2 - 1
            packed = c[:, nb : nb + -(-dim // 2)]
            q = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(c), -1)[:, :dim].astype(np.float32)
            return sign / (np.sqrt(dim) * f[:, None]).astype(np.float32), q * step[:, None] + low[:, None], bounds(f.astype(np.float64), dim)

        def keep(a: np.ndarray, b: np.ndarray, est: np.ndarray, bound: np.ndarray) -> None:
            # Of a block of two different parts, pairs within a part belong to another block.
            near = (est + bound >= min_cosine) & ((block[a] // _PARTS == block[a] % _PARTS) | (first_part[a] != first_part[b]))
            a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
            for k, v in enumerate((ids[a[near]], ids[b[near]], est[near], est[near] - bound[near] >= min_cosine)):
                out[k].append(v)

        few = (size > 1) & (size <= _FEW)
        used = np.repeat(few, size)
        rows = np.flatnonzero(used)
        later = np.repeat(start + size, size)[used] - rows - 1  # partners of a row: those after it in its band
        ends = np.cumsum(later)
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PAIRS)))
            a = np.repeat(rows[i:j], later[i:j])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[i:j]) - later[i:j], later[i:j])
            first, last = rows[i], (b.max() if len(b) else rows[j - 1]) + 1
            sign, q, err = vectors(slice(first, last))
            x, y = a - first, b - first
            keep(a, b, (np.einsum("ij,ij->i", sign[x], q[y]) + np.einsum("ij,ij->i", q[x], sign[y])) / 2, (err[x] + err[y]) / 2)
            i = j
        for s, n in zip(start[size > _FEW], size[size > _FEW]):
            sign, q, err = vectors(slice(s, s + n))
            step = max(1, 4_000_000 // n)
            for i in range(0, n, step):
                j = min(n, i + step)
                a, b = np.nonzero(np.arange(i, n)[None, :] > np.arange(i, j)[:, None])
                est = (sign[i:j] @ q[i:].T + q[i:j] @ sign[i:].T) / 2
                keep(s + i + a, s + i + b, est[a, b], (err[i:j][a] + err[i:][b]) / 2)
        a, b, e, sure = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "estimate": pa.array(e.astype(np.float64)), "sure": pa.array(sure.astype(bool))})

    return run


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, class, v) of the usable vectors, where v is null but for the vector that stands for its class."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~bad & F.exists("v", lambda x: x != 0.0)).groupBy("id").agg(F.min("v").alias("v"))
    v = v.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(SEED), "v").alias("k2"))
    first = v.groupBy("k1", "k2").agg(F.min("id").alias("class"))
    return v.join(first, ["k1", "k2"]).select("id", "class", F.when(F.col("id") == F.col("class"), F.col("v")).alias("v"))


def _spread(coded: DataFrame, keys: DataFrame, split: int, buckets: int) -> DataFrame:
    """With part, block and bucket: a band of up to ``split`` vectors is block 0; a larger one has a block for each pair of its parts."""
    large = small(checkpoint(keys.groupBy("band").agg(F.sum("n").alias("n")).where(F.col("n") > split).select("band", F.ceil(F.col("n") / split).cast("int").alias("parts"))))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    spread = coded.join(large, "band", "left").select("band", "dim", "id", "code", part.alias("part"), other.alias("other"))
    spread = spread.withColumn("block", F.least("part", "other") * _PARTS + F.greatest("part", "other")).drop("other")
    # A block of a large band is a task's work by itself: its bucket is drawn with the block.
    return spread.withColumn("bucket", F.pmod(F.xxhash64("band", "block"), F.lit(buckets)).cast("long") + F.shiftleft(F.col("dim").cast("long"), 32))


def class_pairs(one: DataFrame, min_cosine: float = MIN_COSINE, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(a, b, similarity, recomputed) of pairs a < b of (id, v) rows, all different, with a cosine of at least ``min_cosine``."""
    bands, bits = band_plan(one.count(), min_cosine, recall)
    buckets = 4 * int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = one.mapInArrow(_bands(bands, bits, seed), "band long, dim int, id long, code binary")
    keys = one.mapInArrow(_band_keys(bands, bits, seed), "band long, n long")
    found = _spread(coded, keys, SPLIT, buckets).groupBy("bucket").applyInArrow(_estimate(min_cosine), "a long, b long, estimate double, sure boolean")
    found = checkpoint(found.dropDuplicates(["a", "b"]))  # a pair's estimate is the same in every band
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    exact = (
        found.where("not sure").join(one.toDF("a", "va"), "a").join(one.toDF("b", "vb"), "b")
        .select("a", "b", (dot("va", "vb") / F.sqrt(dot("va", "va")) / F.sqrt(dot("vb", "vb"))).alias("similarity"), F.lit(True).alias("recomputed"))
        .where(F.col("similarity") >= min_cosine)
    )
    sure = found.where("sure").select("a", "b", F.col("estimate").alias("similarity"), F.lit(False).alias("recomputed"))
    return exact.union(sure).select("a", "b", F.round("similarity", 5).alias("similarity"), "recomputed")


def near_pairs(vectors: DataFrame, min_cosine: float = MIN_COSINE, recall: float = RECALL, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, similarity, recomputed): pairs of class ids, and each other member b of a class a with it (similarity 1, not recomputed)."""
    known = checkpoint(classes(vectors, id_col, vector_col))
    copies = known.where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(False).alias("recomputed"))
    return class_pairs(known.where("id = class").select("id", "v"), min_cosine, recall, seed).union(copies)


def near_classes(vectors: DataFrame, min_cosine: float = MIN_COSINE, recall: float = RECALL, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, links, group_id) of every usable vector."""
    known = checkpoint(classes(vectors, id_col, vector_col))
    pairs = checkpoint(class_pairs(known.where("id = class").select("id", "v"), min_cosine, recall, seed).select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    found = links.join(components(pairs).toDF("class", "group"), "class", "left")
    return known.select("id", "class").join(found, "class", "left").select(F.col("id").alias("vec_id"), F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("group", "class").alias("group_id"))


def op9_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_rotated_codes": op9_rotated_codes}
#: Every pair compared: the operator may miss a link with a probability of 1 - RECALL at most.
ORACLES = {
    "op9_rotated_codes": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) > 0),
c AS (SELECT vec_id, embedding, min(vec_id) OVER (PARTITION BY embedding) AS class_id FROM v),
r AS (SELECT class_id AS id, embedding FROM c WHERE vec_id = class_id),
p AS (SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON x.id <> y.id AND list_cosine_similarity(x.embedding, y.embedding) >= {MIN_COSINE}),
reach(id, at) AS (SELECT id, id FROM r UNION SELECT reach.id, p.b FROM reach JOIN p ON reach.at = p.a)
SELECT c.vec_id, c.class_id, (SELECT count(*) FROM p WHERE p.a = c.class_id) AS links, (SELECT min(at) FROM reach WHERE reach.id = c.class_id) AS group_id FROM c"""
}

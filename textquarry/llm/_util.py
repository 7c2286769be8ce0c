"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its names."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(sc, "_tq_shared", None) or "file://" + tempfile.mkdtemp(prefix="tq-shared-")
        sc._tq_shared = where
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and cuts its lineage: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which ``small`` broadcasts.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """A checkpointed table, marked for a broadcast if it has at most ``SMALL`` rows; larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows that have both; every other column, whatever its name, is left behind."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")


#: Size of the Bloom filter of ``with_ids``: 4 MB, whatever the number of documents.
FILTER_BITS = 1 << 25


def _places(ids: np.ndarray) -> np.ndarray:
    h = mix64(ids.astype(np.int64).view(U64) ^ U64(0x2545F4914F6CDD1D))
    return np.stack([h % U64(FILTER_BITS), (h >> U64(32)) % U64(FILTER_BITS)]).astype(np.int64)


def _bloom(ids: DataFrame):
    """A Bloom filter of the ids, broadcast: 4 MB whatever their number."""

    def bits(batches):
        on = np.zeros(FILTER_BITS, bool)
        for b in batches:
            on[_places(b.column(0).to_numpy()).ravel()] = True
        words = np.packbits(on, bitorder="little").view("<i4")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at], pa.int32())], ["at", "word"])

    rows = ids.select("id").mapInArrow(bits, "at int, word int").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(FILTER_BITS // 32, "<i4")
    words[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(words.view(np.uint8))


def _among(on: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids)
    return (on[at >> 3] >> (at & 7) & 1).all(axis=0).astype(bool)


def with_ids(d: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of (id, text) whose id is among ``ids``, and a few others: a Bloom filter spares the rest a shuffle."""
    sent = _bloom(ids)

    def narrowed(batches):
        for b in batches:
            yield b.filter(pa.array(_among(sent.value, b.column(0).to_numpy())))

    return d.select("id", "text").mapInArrow(narrowed, "id long, text string")


def without_ids(d: DataFrame, out: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of (id, text) but for most of those whose id is in ``out``; none whose id is in ``stay`` is lost, and nothing is shuffled.

    A second filter holds those of ``stay`` that the first takes for ids of ``out``. With more ids than the filters can tell apart, more rows of ``out`` stay.
    """
    first = _bloom(out)

    def taken(batches):
        for b in batches:
            yield b.filter(pa.array(_among(first.value, b.column(0).to_numpy())))

    second = _bloom(stay.select("id").mapInArrow(taken, "id long"))

    def narrowed(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            yield b.filter(pa.array(~_among(first.value, ids) | _among(second.value, ids)))

    return d.select("id", "text").mapInArrow(narrowed, "id long, text string")


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
        return x ^ (x >> U64(31))


def mul_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Powers:
    """Growing tables of the powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.p = self.q = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.p):
            n = max(n, 2 * len(self.p))
            self.p, self.q = mul_powers(self.base, n), mul_powers(self.inverse, n)
        return self.p, self.q


_CHARS = Powers(0x9E3779B97F4A7C15 | 1)
_SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_SPACE_TABLE = np.zeros(0x3001, dtype=bool)
_SPACE_TABLE[_SPACES] = True
#: Scripts written without spaces: each of their characters is a word.
_SOLO = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def word_spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs without white space; single characters in scripts without spaces."""
    space = _SPACE_TABLE[np.minimum(cp, 0x3000)] & (cp <= 0x3000)
    inside = np.concatenate(([False], ~space, [False]))
    cut = inside[1:] & ~inside[:-1]
    end = inside[:-1] & ~inside[1:]
    if len(cp) and cp.max() >= 0x0E00:
        solo = np.zeros(len(cp), dtype=bool)
        for a, b in _SOLO:
            solo |= (cp >= a) & (cp <= b)
        after = np.concatenate(([False], solo))
        cut[:-1] |= solo
        cut[1:] |= solo & inside[2:]
        end |= after
        end[:-1] |= solo & inside[:-2]
    return np.flatnonzero(cut), np.flatnonzero(end)


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


def alnum_spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits."""
    inside = np.zeros(len(cp) + 2, dtype=np.int8)
    inside[1:-1] = _alnum()[cp]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's characters, without a loop over words: differences of a prefix polynomial."""
    p, q = _CHARS.get(len(cp) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate((np.zeros(1, U64), np.cumsum((cp.astype(U64) + U64(1)) * p[: len(cp)], dtype=U64)))
        return mix64((prefix[ends] - prefix[starts]) * q[starts])

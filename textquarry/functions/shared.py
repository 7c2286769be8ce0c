"""The folder that all executors share, and checkpoints in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset, as in tests."""
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
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written as a compressed table in the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """With the columns computed by a step of its own: what is filtered or derived from them afterwards doesn't compute them again."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    kept = [c for c in df.columns if c not in columns]
    order = [*df.columns, *(n for n in columns if n not in df.columns)]
    return df.select(*kept, made.alias("__made")).select(*(F.col(f"__made.`{n}`").alias(n) if n in columns else F.col(f"`{n}`") for n in order))


#: Rows up to which ``small`` marks a table for a broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if it has at most ``SMALL`` rows (counted); larger ones are joined by a shuffle."""
    df = checkpoint(df)
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df

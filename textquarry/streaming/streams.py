"""The same transformations over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.functions import text as T
from textquarry.operators import dedup as D


def read(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files at a path: a folder, a pattern, or a single file (as a pattern, since Spark takes no single file)."""
    r = spark.readStream.format(kind).schema(schema)
    if not any(c in path for c in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"
    return (r if files_per_trigger is None else r.option("maxFilesPerTrigger", files_per_trigger)).load(path)


def first_of_key(stream: DataFrame, method: str = "exact", text_col: str = "text", watermark: tuple[str, str] | None = None) -> DataFrame:
    """Rows whose key wasn't seen before. The state is a hash for each key, and with a watermark only for as long."""
    out = stream.withColumn("__key", F.sha2(F.encode(D.key(F.col(text_col), method), "UTF-8"), 256))
    if watermark:
        return out.withWatermark(*watermark).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
    return out.dropDuplicates(["__key"]).drop("__key")


def word_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    return stream.select(F.explode(T.words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time_col: str = "ts", size: str = "1 hour", late: str = "10 minutes", *keys: str) -> DataFrame:
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).groupBy(F.window(time_col, size), *keys).agg(F.count("*").alias("n"))


def for_each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Applies batch transformations to each micro-batch. A batch that is run again overwrites its own folder."""
    return stream.writeStream.foreachBatch(lambda df, k: df.transform(transform).write.mode("overwrite").parquet(f"{path}/batch={k}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs over all that is there, into a table in memory (tests and small results)."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (w if checkpoint is None else w.option("checkpointLocation", checkpoint)).start().awaitTermination()
    return stream.sparkSession.table(name)

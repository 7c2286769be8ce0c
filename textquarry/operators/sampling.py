"""Union, order, subsets, splits and samples. Order and chance come from hashes of ids: the same at every partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textquarry.functions.shared import checkpoint, small


def union_sources(frames: dict[str, DataFrame], name: str = "source") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(name, F.lit(k)) for k, df in frames.items()))


def ordered_distinct(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(first id, text) of each distinct text."""
    return df.groupBy(text_col).agg(F.min(id_col).alias(id_col))


def with_position(df: DataFrame, order: list[Column | str], name: str = "position", slices: int | None = None) -> DataFrame:
    """Global positions from 0, without one task that sorts everything.

    Rows are range-partitioned (into spark.sql.shuffle.partitions ranges by default); each partition numbers its rows after
    those of the partitions before, whose sizes are a small aggregate.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that a lost executor can't put rows into other ranges than those counted.
    part = checkpoint(df.repartitionByRange(slices, *order).withColumn("__part", F.spark_partition_id()))
    sizes = part.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = part.withColumn(name, F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1)
    return inside.join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def subset(df: DataFrame, start: int, end: int, order: str = "doc_id") -> DataFrame:
    """Rows [start, end) in the given order."""
    return df.orderBy(order).offset(start).limit(end - start)


def shuffle_key(seed: int, id_col: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def shuffled(df: DataFrame, seed: int = 42, id_col: str = "doc_id", limit: int | None = None) -> DataFrame:
    out = df.orderBy(shuffle_key(seed, id_col), id_col)
    return out if limit is None else out.limit(limit)


def split(df: DataFrame, ratios: dict[str, float], seed: int = 42, id_col: str = "doc_id", strict: bool = False) -> DataFrame:
    """A column ``split`` of exact sizes: floor(n * ratio) each, the rest to the last. Ratios are scaled to 1, or must be 1 within 0.01."""
    total = sum(ratios.values())
    if total <= 0 or min(ratios.values()) < 0 or (strict and abs(total - 1) > 0.01):
        raise ValueError("ratios must be positive and, if strict, sum to 1")
    placed = with_position(df.withColumn("__key", shuffle_key(seed, id_col)), ["__key", id_col])
    n = placed.agg(F.count("*").alias("__n"))
    placed = placed.crossJoin(F.broadcast(n))
    out, edge = F.lit(list(ratios)[-1]), F.lit(0)
    rules = []
    for name, r in list(ratios.items())[:-1]:
        edge = edge + F.floor(F.col("__n") * F.lit(r / total))
        rules.append((F.col("position") < edge, name))
    for rule, name in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return placed.withColumn("split", out).drop("__key", "position", "__n")


def weighted_sample(df: DataFrame, weights: dict[str, float], n: int, seed: int = 42, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """n draws with replacement: a source by weight, then one of its rows; the draws are numbered by ``draw``."""
    total = sum(weights.values())
    edges, running = [], 0.0
    for name, w in sorted(weights.items()):
        running += w / total
        edges.append((running, name))
    spark = df.sparkSession
    u = lambda tag: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{tag}:"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    source = F.lit(edges[-1][1])
    for edge, name in reversed(edges[:-1]):
        source = F.when(u("s") < edge, name).otherwise(source)
    draws = spark.range(n).select(F.col("id").alias("draw")).select("draw", source.alias(source_col), u("r").alias("__u"))
    rows = df.where(F.col(source_col).isin(list(weights)))
    placed = with_position(rows, [source_col, id_col], "__p")
    sizes = placed.groupBy(source_col).agg(F.count("*").alias("__n"), F.min("__p").alias("__start"))
    sizes = small(sizes)
    numbered = placed.join(sizes, source_col).withColumn("__k", F.col("__p") - F.col("__start")).drop("__p", "__n", "__start")
    picked = draws.join(sizes, source_col).select("draw", source_col, F.floor(F.col("__u") * F.col("__n")).alias("__k"))
    return numbered.join(picked, [source_col, "__k"]).drop("__k")

"""Sinks: distributed writes; small manifests and reports come from the driver."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Hadoop's file system, so that any URI works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def jsonl(df: DataFrame, path: str, append: bool = False, metadata: dict | None = None) -> None:
    """JSON lines in parallel parts; the metadata is a line {"__meta__": ...} in a part that sorts before the others."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)
    if metadata and not append:
        write_file(df.sparkSession, f"{path}/meta-00000.json", json.dumps({"__meta__": metadata}) + "\n")


def txt(df: DataFrame, path: str, separator: str = "\n\n", text_col: str = "text", append: bool = False) -> None:
    df.select(F.col(text_col).cast("string")).write.mode("append" if append else "overwrite").option("lineSep", separator).text(path)


def csv(df: DataFrame, path: str, delimiter: str = ",", columns: list[str] | None = None, append: bool = False, header: bool = True) -> None:
    """White space at the ends of a value stays; an empty text is written as "", a null as nothing."""
    kept = df.select(*[c for c in columns if c in df.columns]) if columns else df
    kept.write.mode("append" if append else "overwrite").options(sep=delimiter, header=header, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def parquet(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def split_dataset(df: DataFrame, path: str, name: str, metadata: dict | None = None, text_col: str = "text") -> dict:
    """A table with a column ``split`` as JSON lines in one folder for each split, with dataset_info.json."""
    df.write.mode("overwrite").partitionBy("split").json(path)
    rows = df.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("b")).collect()
    info = {"name": name, **(metadata or {}), "features": {c: t for c, t in df.dtypes if c != "split"}, "splits": {r.split: {"num_examples": r.n, "num_bytes": r.b} for r in sorted(rows)}}
    write_file(df.sparkSession, f"{path}/dataset_info.json", json.dumps(info, indent=1))
    return info


def model(spark: SparkSession, tokenizer, path: str) -> None:
    """A tokenizer's vocabulary as Parquet and its state as JSON."""
    tokenizer.vocabulary(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
    write_file(spark, f"{path}/tokenizer.json", tokenizer.save())


def load_model(spark: SparkSession, path: str):
    from textquarry.operators import tokenizers

    return tokenizers.load(reduce(lambda a, r: a + r.value, spark.read.text(f"{path}/tokenizer.json", wholetext=True).collect(), ""))

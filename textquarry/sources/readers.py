"""Sources: every reader gives a lazy DataFrame. Limits count the rows that the filters accept."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ALTERNATES = ("content", "sentence", "input_text", "document")
SUFFIXES = {"txt": "text", "text": "text", "md": "text", "csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "orc": "orc", "yaml": "yaml", "yml": "yaml", "xlsx": "excel", "xls": "excel"}


def _text_column(df: DataFrame, text_key: str) -> DataFrame:
    """The text under ``text_key``: from it, from a usual other name, or from the first string column; else no rows."""
    if text_key in df.columns:
        return df
    strings = [c for c, t in df.dtypes if t == "string"]
    name = next((c for c in ALTERNATES if c in df.columns), strings[0] if strings else None)
    return df.withColumnRenamed(name, text_key) if name else df.withColumn(text_key, F.lit(None).cast("string")).limit(0)


def bounded(df: DataFrame, text_key: str = "text", min_length: int = 0, max_length: int | None = None, limit: int | None = None) -> DataFrame:
    """Without empty and short texts; long ones cut; then at most ``limit`` rows."""
    df = df.where(F.col(text_key).isNotNull() & (F.length(text_key) >= max(1, min_length)))
    if max_length is not None:
        df = df.withColumn(text_key, F.substring(text_key, 1, max_length))
    return df if limit is None else df.limit(limit)


def text_files(spark: SparkSession, paths, by_line: bool = False, strip: bool = False, skip_empty: bool = True, text_key: str = "text", separator: str | None = None) -> DataFrame:
    """One row for each file or line (or what stands between separators); .gz is read as it is."""
    df = spark.read.text(paths, wholetext=not by_line, lineSep=separator if by_line else None).withColumnRenamed("value", text_key)
    if strip:
        df = df.withColumn(text_key, F.trim(text_key))
    return df.where(F.length(text_key) > 0) if skip_empty else df


def jsonl(spark: SparkSession, path, text_key: str = "text", schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of JSON lines; damaged lines, metadata lines and rows without a text are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    if schema is not None:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        reader = reader.schema(schema if "__meta__" in schema.names else T.StructType([*schema.fields, T.StructField("__meta__", T.StringType())]))
    df = reader.json(path)
    if "__meta__" in df.columns:
        df = df.where(F.col("__meta__").isNull()).drop("__meta__")
    df = _text_column(df, text_key)
    return df.where(F.col(text_key).isNotNull())


def json_documents(spark: SparkSession, path, text_key: str = "text") -> DataFrame:
    """A file holds an object (a row) or a list of objects (rows)."""
    return _text_column(spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path), text_key)


def csv(spark: SparkSession, path, text_key: str = "text", delimiter: str = ",", encoding: str = "UTF-8", columns: list[str] | None = None, header: bool = True, quoted_empty: bool = False) -> DataFrame:
    """With ``quoted_empty`` a value "" is an empty text, and only one without quotes is null; line ends within texts are left as they are."""
    own = {"nullValue": "\ufffe\x00null", "lineSep": "\n"} if quoted_empty else {}  # what stands for null while reading, in no file
    df = spark.read.options(header=header, sep=delimiter, encoding=encoding, multiLine=True, inferSchema=True, quote='"', escape='"', **own).csv(path)
    df = _text_column(df, text_key)
    return df.select(*[c for c in dict.fromkeys([*columns, text_key]) if c in df.columns]) if columns else df


def csv_texts(spark: SparkSession, path, text_column: str | int | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    """One text for each row: a column by name or place, or all cells joined by the delimiter."""
    df = spark.read.options(header=header, sep=delimiter, multiLine=True, quote='"', escape='"').csv(path)
    if text_column is None:
        return df.select(F.concat_ws(delimiter, *df.columns).alias("text"))
    return df.select(F.col(df.columns[text_column] if isinstance(text_column, int) else text_column).alias("text"))


def json_texts(spark: SparkSession, path, text_field: str | None = None) -> DataFrame:
    """One text for each item: a field (a string, or a list of strings that is flattened), or the item as JSON."""
    df = spark.read.option("multiLine", True).json(path)
    if text_field is None:
        return df.select(F.to_json(F.struct("*")).alias("text"))
    if text_field not in df.columns:
        return df.select(F.lit(None).cast("string").alias("text")).limit(0)
    kind = dict(df.dtypes)[text_field]
    if kind == "array<string>":
        return df.select(F.explode(text_field).alias("text"))
    return df.select(F.col(text_field).alias("text")) if kind == "string" else df.select(F.lit(None).cast("string").alias("text")).limit(0)


def yaml_texts(spark: SparkSession, path: str, text_field: str | None = None) -> DataFrame:
    """As ``json_texts``, for YAML files with a list or a mapping at the root (one task for each file)."""

    def run(batches):
        import pandas as pd
        import yaml

        for pdf in batches:
            out = []
            for body in pdf["content"]:
                root = yaml.safe_load(bytes(body).decode("utf-8", "replace"))
                for item in root if isinstance(root, list) else [root]:
                    value = item if text_field is None else item.get(text_field) if isinstance(item, dict) else None
                    values = value if isinstance(value, list) and text_field else [value]
                    out += [v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values if v is not None]
            yield pd.DataFrame({"text": out}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "text string")


def excel(spark: SparkSession, path: str, text_key: str = "text") -> DataFrame:
    """A workbook's first sheet, read on the driver (needs an Excel engine of pandas)."""
    import pandas as pd

    return _text_column(spark.createDataFrame(pd.read_excel(path)), text_key)


def load(spark: SparkSession, path: str, kind: str | None = None, text_key: str = "text", **bounds) -> DataFrame:
    """A file by its suffix or a named kind; unknown suffixes are read as text."""
    kind = kind or SUFFIXES.get(path.removesuffix(".gz").rsplit(".", 1)[-1].lower(), "text")
    readers: dict[str, Callable[[], DataFrame]] = {
        "text": lambda: text_files(spark, path, text_key=text_key),
        "lines": lambda: text_files(spark, path, by_line=True, text_key=text_key),
        "csv": lambda: csv(spark, path, text_key),
        "json": lambda: json_documents(spark, path, text_key),
        "jsonl": lambda: jsonl(spark, path, text_key),
        "parquet": lambda: _text_column(spark.read.parquet(path), text_key),
        "orc": lambda: _text_column(spark.read.orc(path), text_key),
        "yaml": lambda: yaml_texts(spark, path).withColumnRenamed("text", text_key),
        "excel": lambda: excel(spark, path, text_key),
    }
    return bounded(readers[kind](), text_key, **bounds)


def directory(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, kinds: list[str] | None = None, exclude: list[str] | None = None, text_key: str = "text", sample_files: int | None = None, seed: int = 42, **bounds) -> DataFrame:
    """All files of a folder, one reader for each kind, united by column name, with ``source_path``.

    The list of files (names, not contents) comes from a binaryFile scan and is filtered by suffix and by patterns on the whole path.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path).select("path")
    suffix = F.lower(F.regexp_extract(F.regexp_replace("path", "\\.gz$", ""), "\\.([^./]+)$", 1))
    kind = F.lit(None).cast("string")
    for s, k in SUFFIXES.items():
        kind = F.when(suffix == s, k).otherwise(kind)
    files = found.select("path", kind.alias("kind")).where("kind is not null")
    if kinds:
        files = files.where(F.col("kind").isin(kinds))
    for p in exclude or []:
        files = files.where(~F.col("path").rlike(p))
    if sample_files is not None:
        files = files.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(sample_files)
    by_kind: dict[str, list[str]] = {}
    for r in files.orderBy("path").collect():
        by_kind.setdefault(r.kind, []).append(r.path)
    parts = []
    for k, paths in by_kind.items():
        reader = {"text": text_files, "csv": csv, "json": json_documents, "jsonl": jsonl}.get(k)
        frames = [reader(spark, paths)] if reader else [load(spark, p, k) for p in paths]
        for df in frames:
            if text_key not in df.columns:
                df = _text_column(df, text_key)
            parts.append(df.withColumn("source_path", F.col("_metadata.file_path")) if reader else df)
    if not parts:
        return spark.createDataFrame([], f"{text_key} string, source_path string")
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return bounded(out, text_key, **bounds)


def custom(spark: SparkSession, rows: Iterable | Callable[[], Iterable], mapping: Callable | None = None, schema: str = "text string", text_key: str = "text", limit: int | None = None) -> DataFrame:
    """Rows made on the driver: strings or dicts; items that the mapping fails on, and other types, are skipped."""
    out = []
    for item in rows() if callable(rows) else rows:
        try:
            item = mapping(item) if mapping else item
        except Exception:  # noqa: BLE001  a user's mapping may fail in any way
            continue
        if isinstance(item, str):
            item = {text_key: item}
        if isinstance(item, dict) and item.get(text_key):
            out.append(item)
        if limit is not None and len(out) >= limit:
            break
    names = T._parse_datatype_string(schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in out], schema)


def extract_from_body(body: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """What a fetched page gives: a JSON path where the body is a JSON object, then a pattern's group."""
    from textquarry.functions import text as X

    out = body
    if path:
        out = F.when(F.trim(body).startswith("{"), X.json_path(body, path)).otherwise(body)
    return X.extract(out, pattern) if pattern else out


def web(spark: SparkSession, urls: DataFrame, headers: dict[str, str] | None = None, timeout: float = 30, retries: int = 3, delay: float = 0, data: dict | None = None) -> DataFrame:
    """(source_url, text) of a table (url): fetched in parallel tasks, with retries on 429 and 5xx; failures are left out."""

    def run(batches):
        import time
        import urllib.error
        import urllib.request

        import pandas as pd

        for pdf in batches:
            got = []
            for url in pdf["url"]:
                for k in range(retries + 1):
                    try:
                        request = urllib.request.Request(url, headers=headers or {}, data=json.dumps(data).encode() if data is not None else None)
                        with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
                            got.append((url, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")))
                        break
                    except urllib.error.HTTPError as e:
                        if e.code != 429 and e.code < 500:
                            break
                    except (OSError, ValueError):
                        pass
                    time.sleep(2**k * 0.5)
                time.sleep(delay)
            yield pd.DataFrame(got, columns=["source_url", "text"], dtype=object)

    return urls.select("url").mapInPandas(run, "source_url string, text string")


class IterableSource(DataSource):
    """A source for spark.read.format("tq_generator"): numbered rows of a template, in several partitions; shows how to add one."""

    @classmethod
    def name(cls) -> str:
        return "tq_generator"

    def schema(self) -> str:
        return "id int, text string, source string"

    def reader(self, schema) -> DataSourceReader:
        options = self.options

        class Reader(DataSourceReader):
            def partitions(self):
                n, parts = int(options.get("rows", 20)), int(options.get("partitions", 2))
                return [InputPartition((k * n // parts, (k + 1) * n // parts)) for k in range(parts)]

            def read(self, partition) -> Iterator[tuple]:
                for i in range(*partition.value):
                    yield i, options.get("template", "sample text {i}").replace("{i}", str(i)), "tq_generator"

        return Reader()


def exclude_paths(df: DataFrame, patterns: list[str], column: str = "source_path") -> DataFrame:
    for p in patterns:
        re.compile(p)
        df = df.where(~F.col(column).rlike(p))
    return df


def count_lines(spark: SparkSession, paths) -> int:
    """Lines of text files, counted where they are."""
    return spark.read.text(paths).count()


def chunks(spark: SparkSession, paths, size: int = 1 << 20) -> DataFrame:
    """(path, chunk, content): files as pieces of ``size`` bytes; a task reads one file piece by piece and never holds it whole."""
    files = spark.read.format("binaryFile").load(paths).select("path")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name, compression=None) as f:
                    k = 0
                    while part := f.read(size):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([part], pa.binary())], ["path", "chunk", "content"])
                        k += 1

    return files.mapInArrow(run, "path string, chunk long, content binary")

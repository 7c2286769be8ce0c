"""From a configuration to a corpus, a tokenizer and its metrics. Steps hand DataFrames on; actions come only with training and output."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.functions.shared import checkpoint
from textquarry.operators import sentencepiece as _sentencepiece  # noqa: F401  it registers itself
from textquarry.operators import clean as C, code as K, dedup as D, filters as FL, metrics as M, sampling as S, tokenizers as TK
from textquarry.sources import readers as R

#: Names of metrics in configurations that mean one of ours.
METRIC_NAMES = {"unknown_rate": "unk_analysis", "token_efficiency": "compression"}
ENCODINGS = ("utf-8", "cp1254", "latin-1", "windows-1252")


@dataclass
class PipelineConfig:
    sources: list[dict] = field(default_factory=list)
    clean: dict = field(default_factory=dict)
    filter: dict = field(default_factory=dict)
    dedup: str | None = "exact"
    similarity: float = 1.0
    limit: int | None = None
    shuffle: bool = False
    seed: int = 42
    tokenizer: dict = field(default_factory=lambda: {"kind": "bpe", "merges": 200})
    split: dict[str, float] = field(default_factory=lambda: {"train": 0.8, "valid": 0.1, "test": 0.1})
    metrics: list[str] = field(default_factory=lambda: ["compression", "token_frequency", "sequence_length"])


def merge(base: dict, *more: dict) -> dict:
    """Later values win; mappings are merged key by key."""
    out = dict(base)
    for d in more:
        for k, v in d.items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def get(config: dict, dotted: str, default=None):
    """A value by a dotted key."""
    for k in dotted.split("."):
        if not isinstance(config, dict) or k not in config:
            return default
        config = config[k]
    return config


def load_config(*paths: str) -> PipelineConfig:
    """YAML files merged in order (defaults, template, own); unknown keys are an error."""
    import yaml

    def read(path: str) -> dict:
        with open(path, "rb") as f:
            data = f.read()
        for name in ENCODINGS:
            try:
                return yaml.safe_load(data.decode(name)) or {}
            except UnicodeDecodeError:
                continue
        raise ValueError(f"unknown encoding: {path}")

    return config_from(merge({}, *map(read, paths)))


def config_from(values: dict) -> PipelineConfig:
    known = {f.name for f in fields(PipelineConfig)}
    if wrong := set(values) - known:
        raise ValueError(f"unknown settings {sorted(wrong)}; there are {sorted(known)}")
    return PipelineConfig(**values)


def build_source(spark: SparkSession, source: dict) -> DataFrame:
    """A source by its kind: directory, custom rows, a table, or any file kind that ``readers.load`` knows."""
    s = dict(source)
    kind = s.pop("kind", None)
    if kind == "directory":
        return R.directory(spark, **s)
    if kind == "custom":
        return R.custom(spark, **s)
    if kind == "table":
        return s["table"]
    return R.load(spark, s.pop("path"), kind, **s)


def build_transform(step: dict) -> Callable[[DataFrame], DataFrame]:
    """A transformation by its kind: text, code, filter, dedup, or a list of them as a pipeline."""
    s = dict(step)
    kind = s.pop("kind")
    if kind == "text":
        return C.clean_text(C.CleanConfig(**s))
    if kind == "code":
        language = s.pop("language", None)
        return lambda df: df.withColumn("text", K.clean_code(F.col("text"), None if language is None else F.lit(language), K.CodeConfig(**s)))
    if kind == "filter":
        return lambda df: FL.keep(df, FL.FilterConfig(**s))
    if kind == "dedup":
        return lambda df: dedup(df, **s)
    if kind == "pipeline":
        steps = [build_transform(x) for x in s["steps"]]
        return lambda df: C.pipeline(df, steps)
    raise ValueError(f"unknown kind {kind!r}")


def dedup(df: DataFrame, method: str = "exact", similarity: float = 1.0) -> DataFrame:
    """By key; by MinHash where a similarity below 1 is asked for."""
    return D.drop_similar(df, similarity) if method == "minhash" or similarity < 1 else D.dedup(df, method)


def collect(spark: SparkSession, config: PipelineConfig) -> DataFrame:
    """(doc_id, text, source): sources united, cleaned, filtered, limited, without duplicates, and shuffled if asked for.

    Rows are numbered by source and text, so that ids don't depend on how files are split over tasks.
    """
    frames = {s.get("name", f"source{k}"): build_source(spark, {a: b for a, b in s.items() if a != "name"}).select("text") for k, s in enumerate(config.sources)}
    df = S.union_sources(frames).transform(C.clean_text(C.CleanConfig(**config.clean)))
    df = FL.keep(df, FL.FilterConfig(**config.filter))
    df = S.with_position(df, ["source", "text"], "doc_id")
    if config.limit is not None:
        df = df.where(F.col("doc_id") < config.limit)
    if config.dedup:
        df = dedup(df, config.dedup, config.similarity)
    df = df.select("doc_id", "text", "source")
    return S.shuffled(df, config.seed) if config.shuffle else df


def run(spark: SparkSession, config: PipelineConfig, steps: tuple[str, ...] = ("train", "evaluate")) -> dict:
    """{"corpus", "split", "tokenizer", "metrics"}: the corpus is written once to the shared folder and read by the steps."""
    corpus = checkpoint(collect(spark, config))
    out: dict = {"corpus": corpus, "split": S.split(corpus, config.split, config.seed)}
    if "train" in steps:
        settings = dict(config.tokenizer)
        first = next(iter(config.split))
        out["tokenizer"] = model = TK.build(settings.pop("kind"), out["split"].where(F.col("split") == first), **settings)
        if "evaluate" in steps:
            tokens = F.transform(model.encode(F.col("text")), lambda i: i.cast("string"))
            held = out["split"].where(F.col("split") != first).select("doc_id", "text", tokens.alias("tokens"))
            out["metrics"] = M.evaluate(held, [METRIC_NAMES.get(m, m) for m in config.metrics])
    return out


def compose(*transforms: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: reduce(lambda d, t: d.transform(t), transforms, df)

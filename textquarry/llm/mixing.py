"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by the MD5 of seed and id). A document's virtual finish time is its source's
token count up to and including it, divided by the source's target weight. All documents are put in order of that
time, and the order is cut where the running token count would pass the budget: at any point the sources' shares
follow the weights, for as long as each source lasts.

No window runs over a whole source or over the whole table. Shuffled order is split into buckets by the first hex
digits of the hash, and the order of time into ranges of about equal numbers of documents (a global range sort); running
sums are taken inside a bucket or range and offset by the sums of the earlier ones, which come from a small aggregate. A
hot source is spread over all its buckets. Texts are read once; what is sorted and written holds ids, hashes and counts.

Tokens are counted by ``tokens``, a column of the table (of a tokenizer's counts) or an expression over it; without one they are runs of characters other than space,
tab, newline, carriage return and form feed.

Defined results: rows with a null id or null text can't be ordered or counted and are left out; a null source is a
source of its own named "" ; an empty text has 0 tokens and is taken if its time comes; rows that repeat an id
are separate documents, in order of their text. Sources with weight 0 or less are left out. Ties in time are
broken by source, shuffle key, id and token count. Texts of any length are counted whole. Empty tables give empty results.
Extra columns don't matter; ``mix_documents`` returns them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from textquarry.llm._util import checkpoint, fresh, table

#: Production parameters.
WEIGHTS, DEFAULT_WEIGHT, BUDGET_SHARE, SEED = {"src0": 6.0}, 1.0, 0.6, "42"
HEX_DIGITS = 3


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")).cast("long")


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in sorted(weights.items()):
        out = F.when(source == name, F.lit(float(w))).otherwise(out)
    return out


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` up to and including each row, in order of bucket and order, within keys."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__b"))
    before = sums.withColumn("__before", F.sum("__b").over(W.partitionBy(*keys).orderBy(bucket)) - F.col("__b")).drop("__b")
    inside = df.withColumn("__in", F.sum(value).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return inside.join(before, [*keys, bucket]).withColumn(out, F.col("__before") + F.col("__in")).drop("__before", "__in")


def schedule(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget_share: float = BUDGET_SHARE, budget: int | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, finish, running_tokens) of the documents within the budget.

    ``budget`` is in tokens; without it, ``budget_share`` of all tokens is taken.
    """
    d = (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), (n_tokens(F.col(text_col)) if tokens is None else F.greatest(F.coalesce(tokens.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))).alias("n_tokens"), F.md5(F.col(text_col)).alias("tie"))
        .withColumn("w", _weight(F.col("source"), weights, default_weight)).where("w > 0")
        .withColumn("key", F.md5(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string"))))
        .withColumn("bucket", F.substring("key", 1, HEX_DIGITS))
    )
    d = checkpoint(d)  # read four times below: the texts are counted and hashed once
    order = ["finish", "source", "key", "doc_id", "tie"]
    timed = _running(d, ["source"], "bucket", ["key", "doc_id", "tie"], "n_tokens", "tokens_so_far").withColumn("finish", F.col("tokens_so_far") / F.col("w")).select(*order, "n_tokens")
    # Written, so that a lost executor can't put rows into other ranges than those summed.
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(timed.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()).withColumn("all", F.lit(0)))
    total = d.agg(F.sum("n_tokens").alias("total"))
    limit = F.lit(int(budget)) if budget is not None else F.floor(F.lit(float(budget_share)) * F.col("total"))
    ranked = _running(ranged, ["all"], "range", order, "n_tokens", "running_tokens").join(F.broadcast(total.select(limit.alias("limit"))))  # one row
    return ranked.where("running_tokens <= limit").select("doc_id", "source", "n_tokens", F.round("finish", 6).alias("finish"), "running_tokens", F.col("tie").alias("__tie"))


def mix_schedule(docs: DataFrame, **parameters) -> DataFrame:
    return schedule(docs, **parameters).drop("__tie")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` within the budget, with all their columns. Equal rows (id and text) go or stay together."""
    kept = schedule(docs, id_col=id_col, text_col=text_col, **parameters)
    a, b = fresh(docs, "mix_id"), fresh(docs, "mix_tie")
    kept = kept.groupBy(F.col("doc_id").alias(a), F.col("__tie").alias(b)).agg(F.lit(1).alias("one")).drop("one")
    return docs.join(kept, (F.col(id_col).cast("long") == F.col(a)) & (F.md5(F.col(text_col)) == F.col(b)), "left_semi")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_schedule(table(spark, sf_dir, "documents"))


def oracle(weights: dict[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget_share: float = BUDGET_SHARE, seed: str = SEED, docs: str = "documents") -> str:
    cases = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in sorted(weights.items()))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))::BIGINT AS n_tokens, md5(text) AS tie,
         md5('{seed}:' || doc_id::VARCHAR) AS key, CASE coalesce(source, '') {cases} ELSE {float(default_weight)} END::DOUBLE AS w
  FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
f AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id, tie ROWS UNBOUNDED PRECEDING)::DOUBLE / w AS finish FROM d),
r AS (SELECT *, sum(n_tokens) OVER (ORDER BY finish, source, key, doc_id, tie ROWS UNBOUNDED PRECEDING)::BIGINT AS running_tokens FROM f)
SELECT doc_id, source, n_tokens, round(finish, 6) AS finish, running_tokens FROM r
WHERE running_tokens <= floor({float(budget_share)} * (SELECT sum(n_tokens) FROM d))"""


QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": oracle()}

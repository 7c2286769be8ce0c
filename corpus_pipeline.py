"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

1. toxicity: documents over the lexicon's threshold go.
2. SimHash near-dedup: of each group of copies and near copies the smallest id stays.
3. secret scans: each secret is replaced by [SECRET]; all documents stay.
4. mixing: the documents that weighted fair queueing takes up to the token budget; only this cut takes effect, the
   stage's output is in no particular order.
5. byte-level BPE: the documents with their token ids.

Null texts pass stages 1 to 3 (nothing in them to reject), are left out by stage 4, which can't count them, and so is
any row with a null id. Empty texts pass all stages as copies of each other, of which stage 2 keeps the smallest id. Texts of any length
are read whole. Rows that repeat an id and text go or stay together. Extra columns pass through, whatever their names (the ids' column
then gets another name). Empty tables give empty tables. A stage's folder goes once the next stage is written; the last one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import bpe_prefix, mixing, secret_scan, simhash_anchors, toxicity
from textquarry.llm._util import shared_dir
from textquarry.plans.ship import ship

#: Share of the tokens that the mixing stage takes.
BUDGET_SHARE = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash_anchors.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix_documents(docs, budget_share=BUDGET_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe_prefix.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("mixing", mix_sources), ("bpe_encode", encode)]

#: SQL can't express folding with an automaton, fingerprints, or BPE; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if k:
            _remove(spark, done)
        docs, done = spark.read.parquet(out), out
    return docs

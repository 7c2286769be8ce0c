"""python -m textquarry VERB ...: analyze, train, encode, decode and evaluate from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, functions as F

from textquarry.operators import metrics as M, stats, tokenizers as K
from textquarry.plans.ship import ship
from textquarry.sources import readers as R, writers as W


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="textquarry", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("analyze", "train", "encode", "decode", "evaluate"):
        v = verbs.add_parser(verb)
        v.add_argument("input")
        v.add_argument("output")
        v.add_argument("--kind", help="of the input file")
        v.add_argument("--model", help="folder of a trained tokenizer")
        v.add_argument("--tokenizer", default="bpe", choices=sorted(K.BUILDERS))
        v.add_argument("--settings", type=json.loads, default={}, help="of the tokenizer, as JSON")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    df = spark.read.parquet(a.input) if a.verb == "decode" else R.load(spark, a.input, a.kind)
    if a.verb == "analyze":
        W.write_file(spark, a.output, stats.report(df))
    elif a.verb == "train":
        W.model(spark, K.build(a.tokenizer, df, **a.settings), a.output)
    else:
        model = W.load_model(spark, a.model)
        if a.verb == "encode":
            W.parquet(df.withColumn("ids", model.encode(F.col("text"))), a.output)
        elif a.verb == "decode":
            W.parquet(df.withColumn("text", model.decode(F.col("ids"))), a.output)
        else:
            tok = df.select("text", F.transform(model.encode(F.col("text")), lambda i: i.cast("string")).alias("tokens"))
            report = {name: m.first().asDict() for name, m in M.evaluate(tok, ["compression", "token_frequency", "sequence_length"]).items()}
            W.write_file(spark, a.output, json.dumps(report, indent=1, default=float))


if __name__ == "__main__":
    main()

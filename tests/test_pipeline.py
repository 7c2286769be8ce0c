import json

import pytest
from pyspark.sql import functions as F

from textquarry import __main__ as cli
from textquarry.plans import pipeline as P


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("seed: 1\nclean: {lowercase: true, min_length: 3}\n")
    (tmp_path / "b.yaml").write_bytes("clean: {min_length: 5}\ntokenizer: {kind: byte_level}\n# ş\n".encode("cp1254"))
    c = P.load_config(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"))
    assert c.seed == 1 and c.clean == {"lowercase": True, "min_length": 5} and c.tokenizer == {"kind": "byte_level"} and c.dedup == "exact"
    assert P.get({"a": {"b": 2}}, "a.b") == 2 and P.get({"a": 1}, "a.b", 7) == 7
    with pytest.raises(ValueError):
        P.config_from({"nonsense": 1})


def test_run(spark):
    rows = [f"Sample   text number {k % 40} &amp; more" for k in range(60)] + ["x", None]
    config = P.config_from({"sources": [{"name": "own", "kind": "custom", "rows": rows}], "filter": {"min_length": 5}, "limit": 50, "tokenizer": {"kind": "bpe", "merges": 20}, "metrics": ["unknown_rate", "token_efficiency"]})
    out = P.run(spark, config)
    texts = [r.text for r in out["corpus"].collect()]
    assert len(texts) == len(set(texts)) <= 40 and all("  " not in t and " & " in t for t in texts)
    assert out["metrics"]["compression"].first().total_ratio > 1 and set(out["metrics"]) == {"unk_analysis", "compression"}
    assert {r.split for r in out["split"].select("split").distinct().collect()} == {"train", "valid", "test"}


def test_build_transform(spark):
    df = spark.createDataFrame([(1, "A  // gone"), (2, "a"), (3, "a")], "doc_id long, text string")
    step = P.build_transform({"kind": "pipeline", "steps": [{"kind": "code", "language": "javascript"}, {"kind": "text", "lowercase": True}, {"kind": "dedup"}]})
    assert [(r.doc_id, r.text) for r in df.transform(step).collect()] == [(1, "a")]
    assert df.transform(P.compose(P.build_transform({"kind": "filter", "min_length": 2}))).count() == 1
    with pytest.raises(ValueError):
        P.build_transform({"kind": "none"})


def test_command_line(spark, tmp_path):
    (tmp_path / "in.txt").write_text("low lower lowest\nlow low\n")
    at = lambda name: str(tmp_path / name)
    cli.main(["train", at("in.txt"), at("model"), "--settings", '{"merges": 5}'])
    cli.main(["encode", at("in.txt"), at("ids"), "--model", at("model")])
    cli.main(["decode", at("ids"), at("back"), "--model", at("model")])
    assert spark.read.parquet(at("back")).select(F.first("text")).first()[0] == "low lower lowest\nlow low\n"
    cli.main(["evaluate", at("in.txt"), at("report.json"), "--model", at("model")])
    assert json.loads((tmp_path / "report.json").read_text())["compression"]["total_ratio"] > 1
    cli.main(["analyze", at("in.txt"), at("report.md")])
    assert (tmp_path / "report.md").read_text().startswith("# Corpus report")

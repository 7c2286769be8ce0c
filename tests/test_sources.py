import json

import pytest
from pyspark.sql import functions as F

from textquarry.operators import tokenizers as K
from textquarry.sources import readers as R, writers as WR
from textquarry.streaming import streams as ST


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("first text")
    (tmp_path / "b.txt").write_text("second")
    (tmp_path / "sub" / "c.txt").write_text("third")
    (tmp_path / "sub" / "d.json").write_text('{"text": "fourth", "metadata": {"source": "x"}}')
    (tmp_path / "e.jsonl").write_text('{"__meta__": {"v": 1}}\n{"text": "l1", "id": 1}\nbroken{\n\n{"id": 3}\n{"text": "l2", "id": 2}\n')
    (tmp_path / "f.csv").write_text('id,text,language\n1,"one, two",en\n2,"three\nlines",tr\n')
    return tmp_path


def values(df, c="text"):
    return sorted(r[c] for r in df.collect())


def test_directory(spark, folder):
    assert values(R.directory(spark, str(folder), kinds=["text"])) == ["first text", "second", "third"]
    assert values(R.directory(spark, str(folder), kinds=["text"], recursive=False)) == ["first text", "second"]
    assert values(R.directory(spark, str(folder), kinds=["json"])) == ["fourth"]
    assert values(R.directory(spark, str(folder), kinds=["text"], exclude=["sub/"])) == ["first text", "second"]
    assert R.directory(spark, str(folder), kinds=["parquet"]).count() == 0
    assert R.directory(spark, str(folder)).count() == 8


def test_files(spark, folder):
    assert values(R.jsonl(spark, str(folder / "e.jsonl"))) == ["l1", "l2"]
    got = R.csv(spark, str(folder / "f.csv"), columns=["id"])
    assert got.columns == ["id", "text"] and values(got) == ["one, two", "three\nlines"]
    assert values(R.csv_texts(spark, str(folder / "f.csv"), 2)) == ["en", "tr"]
    assert values(R.load(spark, str(folder / "a.txt"), max_length=5)) == ["first"]
    assert R.load(spark, str(folder / "a.txt"), min_length=50).count() == 0


def test_json_texts(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"items": ["a", "b"], "t": "x"}')
    assert values(R.json_texts(spark, str(tmp_path / "l.json"), "items")) == ["a", "b"]
    assert values(R.json_texts(spark, str(tmp_path / "l.json"), "t")) == ["x"]
    assert R.json_texts(spark, str(tmp_path / "l.json"), "none").count() == 0
    assert json.loads(values(R.json_texts(spark, str(tmp_path / "l.json")))[0])["t"] == "x"


def test_custom(spark):
    got = R.custom(spark, ["a", {"text": "b"}, 3, {"other": 1}, "bad"], lambda x: 1 / 0 if x == "bad" else x)
    assert values(got) == ["a", "b"]
    spark.dataSource.register(R.IterableSource)
    assert spark.read.format("tq_generator").option("rows", 7).load().count() == 7


def test_extract_from_body(spark):
    df = spark.createDataFrame([('{"a": {"b": [{"c": "hit"}]}}',), ("plain <t>in</t>",)], "body string")
    assert [r[0] for r in df.select(R.extract_from_body(F.col("body"), "a.b.0.c")).collect()] == ["hit", "plain <t>in</t>"]
    assert df.select(R.extract_from_body(F.col("body"), pattern="<t>(.*)</t>")).collect()[1][0] == "in"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", "train"), (2, 'q"u, o', "test")], "id long, text string, split string")
    WR.csv(df, str(tmp_path / "csv"), columns=["id", "text", "none"])
    assert values(R.csv(spark, str(tmp_path / "csv"))) == ["a\nb", 'q"u, o']
    info = WR.split_dataset(df, str(tmp_path / "ds"), "mine")
    assert info["splits"]["train"] == {"num_examples": 1, "num_bytes": 3} and json.loads((tmp_path / "ds" / "dataset_info.json").read_text()) == info
    WR.jsonl(df, str(tmp_path / "j"), metadata={"v": 1})
    assert json.loads((tmp_path / "j" / "meta-00000.json").read_text()) == {"__meta__": {"v": 1}}
    WR.txt(df, str(tmp_path / "t"))
    model = K.Bpe.train(df, 5)
    WR.model(spark, model, str(tmp_path / "m"))
    assert WR.load_model(spark, str(tmp_path / "m")) == model


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00")]
    spark.createDataFrame(rows, "text string, t string").selectExpr("text", "timestamp(t) as ts").write.parquet(str(tmp_path / "in"))
    stream = lambda: ST.read(spark, str(tmp_path / "in"), "text string, ts timestamp")
    assert values(ST.drain(ST.first_of_key(stream()), "tq_a")) == ["a", "b"]
    assert {r.word: r.n for r in ST.drain(ST.word_counts(stream()), "tq_b", "complete").collect()} == {"a": 2, "b": 1}
    assert sorted(r.n for r in ST.drain(ST.windowed_counts(stream()), "tq_c", "complete").collect()) == [1, 2]
    q = ST.for_each_batch(stream(), lambda df: df.where("text = 'a'"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2

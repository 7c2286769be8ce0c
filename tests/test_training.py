"""Marked-space models, training with history, and the counters of a run."""

import json

import pytest
from pyspark.sql import functions as F

from textquarry.operators import clean as C, sentencepiece as SP, stats, tokenizers as K, training as TR
from textquarry.sources import readers as R, writers as WR

TEXTS = ["the lower the newer", "newest and  widest\nof all", "low low lower", "", None, "über 12"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def column(df, c):
    return [r.x for r in df.select("doc_id", c.alias("x")).orderBy("doc_id").collect()]


@pytest.mark.parametrize("kind", ("unigram", "bpe", "char", "word"))
def test_marked_spaces_round_trip(df, kind):
    model = SP.SentencePiece.train(df, 120, kind, character_coverage=1.0)
    want = [None if t is None else " ".join(t.split()) for t in TEXTS]
    assert column(df, model.decode(model.encode(F.col("text")))) == want
    again = K.load(model.save())
    assert again.save() == model.save() and column(df, again.encode(F.col("text"))) == column(df, model.encode(F.col("text")))
    if kind in ("unigram", "bpe"):
        sampled = model.encode(F.col("text"), sample=True, alpha=0.3)
        assert column(df, model.decode(sampled)) == want and column(df, sampled) == column(df, model.encode(F.col("text"), sample=True, alpha=0.3))
        assert len(column(df, model.tokenize(F.col("text")))[2]) < len("low low lower")


def test_unknown_and_bytes(spark, df):
    x = spark.createDataFrame([(1, "low 一")], "doc_id long, text string")
    plain = SP.SentencePiece.train(df, 60, "char")
    assert column(x, plain.decode(plain.encode(F.col("text")))) == ["low <unk>"]
    fallback = SP.SentencePiece.train(df, 400, "char", byte_fallback=True)
    assert column(x, fallback.decode(fallback.encode(F.col("text")))) == ["low 一"]
    with pytest.raises(ValueError):
        SP.SentencePiece.train(df, 60, "other")


def test_history_and_early_stop(df):
    seen = []
    model, history = TR.train(df.where("text is not null"), df.where("text is not null"), "bpe", [{"merges": n, "min_frequency": 1} for n in (0, 5, 20, 20, 20, 40)], patience=2, callbacks=[lambda s, m: seen.append(s.number)])
    assert history.stopped_early and history.best == 2 and seen == [0, 1, 2, 3, 4] and len(model.merges) == 20
    rates = [s.chars_per_token for s in history.steps]
    assert rates[0] < rates[1] < rates[2] == rates[3] and json.loads(history.as_json())["best"] == 2
    _, stopped = TR.train(df, df, "byte_level", [{}] * 3, callbacks=[lambda s, m: True])
    assert len(stopped.steps) == 1


def test_collector(df):
    c = TR.Collector()
    out = df.transform(c.watch("raw")).transform(C.clean_text(C.CleanConfig(lowercase=True))).transform(c.watch("clean"))
    assert out.count() == 4
    raw, clean = c.report()
    assert raw["rows"] == 6 and raw["empty"] == 2 and clean["rows"] == 4 and clean["rows_dropped"] == 2 and -5 < clean["char_change_percent"] < 0 and c.chars_per_second() > 0


def test_stats_lines_and_chunks(spark, df, tmp_path):
    got = stats.save_stats(df, f"{tmp_path}/stats.json")
    assert json.loads((tmp_path / "stats.json").read_text()) == json.loads(json.dumps(got)) and got["top_words"]["low"] == 2
    (tmp_path / "a.txt").write_bytes(b"one\ntwo\nthree\n")
    assert R.count_lines(spark, f"{tmp_path}/a.txt") == 3
    rows = R.chunks(spark, f"{tmp_path}/a.txt", 5).orderBy("chunk").collect()
    assert [bytes(r.content) for r in rows] == [b"one\nt", b"wo\nth", b"ree\n"]


def test_jsonl_metadata_line(spark, df, tmp_path):
    WR.jsonl(df, f"{tmp_path}/j", metadata={"name": "n"})
    assert R.jsonl(spark, f"{tmp_path}/j").count() == 5 and R.jsonl(spark, f"{tmp_path}/j", schema="doc_id long, text string").columns == ["doc_id", "text"]

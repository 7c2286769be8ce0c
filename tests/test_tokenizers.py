from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import metrics as M, tokenizers as K

ROWS = ["low lower lowest low low", "new newer newest wide wider", "it's 12 cafés ığş \U0001f600!", "", None]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(ROWS)), "doc_id long, text string")


def pairs(df, *columns):
    return [tuple(r) for r in df.orderBy("doc_id").select(*columns).collect()]


def brute_bpe(pieces, merges, least):
    words = {tuple(bytes([b]) for b in p.encode()): 0 for p in pieces}
    for p, n in pieces.items():
        words[tuple(bytes([b]) for b in p.encode())] += n
    out = []
    while len(out) < merges:
        count = Counter()
        for w, n in words.items():
            for p in zip(w, w[1:]):
                count[p] += n
        if not count:
            break
        best = min(count, key=lambda p: (-count[p], p))
        if count[best] < least:
            break
        out.append(best)
        new = Counter()
        for w, n in words.items():
            x, i = [], 0
            while i < len(w):
                two = w[i : i + 2] == best
                x.append(w[i] + w[i + 1] if two else w[i])
                i += 2 if two else 1
            new[tuple(x)] += n
        words = new
    return out


def test_bpe_merges_against_brute_force(spark, df):
    pieces = {r.piece: r.n for r in K.pretoken_counts(df).collect()}
    assert K.Bpe.train(df, 30).merges == brute_bpe(pieces, 30, 2)


def test_round_trips(df):
    for model in (K.ByteLevel(), K.Bpe.train(df, 20), K.Bpe.train(df, 20, mode="approx")):
        got = pairs(df.withColumn("ids", model.encode(F.col("text"))).withColumn("back", model.decode(F.col("ids"))), "text", "back")
        assert all(a == b for a, b in got)


def test_wordpiece(spark, df):
    model = K.WordPiece.train(df, 60)
    assert model.pieces("low") == ["low"] and model.pieces("z" * 101) == ["[UNK]"] and model.pieces("一") == ["[UNK]"]
    for word in "lower newest wider".split():
        assert "".join(p.removeprefix("##") for p in model.pieces(word)) == word
    same = K.WordPiece(["ab", "##c"])
    row = spark.range(1).select(same.decode(F.array(F.lit(0), F.lit(1))), same.decode(F.array(F.lit(0), F.lit(1)), glue=False)).first()
    assert tuple(row) == ("abc", "ab c")


def test_unigram_is_best_cut(df):
    model = K.Unigram.train(df, 40, iterations=3)

    def best(w):
        if not w:
            return 0.0
        return max((model.scores[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in model.scores), default=-1e9)

    for w in "low lower newest wide".split():
        cut = model.segment(w)
        assert "".join(cut) == w and abs(sum(model.scores[p] for p in cut) - best(w)) < 1e-9


def test_save_and_load(df):
    for model in (K.Bpe.train(df, 10), K.WordPiece.train(df, 50), K.Unigram.train(df, 40, 2)):
        again = K.load(model.save())
        e = pairs(df.select("doc_id", model.encode(F.col("text")).alias("a"), again.encode(F.col("text")).alias("b")), "a", "b")
        assert all(a == b for a, b in e)


def test_mixed(df):
    mixed = K.Mixed({"byte": K.ByteLevel(), "bpe": K.Bpe.train(df, 10)}, K.regex_router([("\\d", "byte"), ("new", "bpe")], "nothing"), "bpe")
    got = pairs(mixed.decode(mixed.encode(df.where("text is not null"))), "tokenizer", "text", "decoded")
    assert [g[0] for g in got] == ["bpe", "bpe", "byte", "bpe"] and all(a == b for _, a, b in got)
    with pytest.raises(ValueError):
        K.build("nothing")


def test_special_tokens(df):
    assert K.ByteLevel().special_ids() == {} and K.ByteLevel(258).special_ids() == {"[PAD]": 256, "[UNK]": 257}
    assert pairs(df, K.ByteLevel(300).encode(F.col("text"), add_special=True))[3] == ([258, 259],)


def test_differences(spark):
    x = spark.createDataFrame([("abcd", "abxd"), ("same", "same"), ("", "ab")], "a string, b string")
    rows = x.select(M.matching_ratio(F.col("a"), F.col("b")).alias("r"), M.differences(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.r for r in rows] == [75.0, 100.0, 0.0] and tuple(rows[0].d) == (0, 0, 1) and tuple(rows[2].d) == (2, 0, 0)


def test_metric_registry(spark, df):
    tok = df.where("text <> ''").select("doc_id", "text", T.words(F.col("text")).alias("tokens"))
    got = M.evaluate(tok, ["unk_analysis", "texts"], {"texts": lambda t: t.agg(F.count("*").alias("n"))})
    assert got["texts"].first().n == 3 and got["unk_analysis"].first().unk == 0

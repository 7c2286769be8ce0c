"""Cases of the reviews' findings."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textquarry.functions import arrow as A, text as T, unicode as U
from textquarry.operators import dedup as D, extract as E, tokenizers as K
from textquarry.sources import readers as R, writers as WR


def test_csv_keeps_every_text(spark, tmp_path):
    texts = [" lead", "trail ", "\tx\t", " ", "\n", "\r", "a\rb", "a\r\nb", "\r\nx", "x\n", '"', '""', 'a",b', "\\", '\\"', "null", "#x", "\x00", "\x00a", "　", "\x1ea", "a,b", ' " x', "1", "text"]
    rows = [(k, t, ("en", "", None, " de ")[k % 4]) for k, t in enumerate(texts)]
    WR.csv(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2), str(tmp_path / "c"), columns=["doc_id", "text", "lang"])
    got = R.bounded(R.csv(spark, str(tmp_path / "c"), columns=["doc_id", "lang"], quoted_empty=True)).select(F.col("doc_id").cast("long"), "text", "lang")
    assert sorted(tuple(r) for r in got.collect()) == rows


def test_entities_without_their_end(spark):
    texts = ["a &amp", "b&amp;c &copy;2 &copy=1 &am", "&quot;&middot;&#65;&#x42; &nosuch; &notit;", "&&&amp;amp;", None]
    x = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", U.fix(F.col("text"), nfc=False, accents=False, ended=True).alias("x"))
    assert [r.x for r in x.orderBy("k").collect()] == ["a &amp", "b&c ©2 &copy=1 &am", '"·AB &nosuch; &notit;', "&&&amp;", None]


def test_batches_in_parts(spark):
    """What a function holds beside its batch is bounded, whatever the batch's rows; cut anywhere, the results are the same."""
    sizes = np.array([3, 0, 9, 2, 2, 50, 1])
    edges = A._edges(sizes, 10)
    assert edges == [0, 2, 3, 5, 6, 7] and all(y - x == 1 or sizes[x:y].sum() <= 10 for x, y in zip(edges, edges[1:]))
    lists = pa.array([["a"] * 300_000, None, ["b"] * 400_000, [], ["c"]])
    seen = []
    got = A.in_parts(lists, lambda v: (seen.append(len(v.flatten())), v)[1])
    assert got.equals(lists) and max(seen) <= A.ITEMS and len(seen) > 1
    text = "é" * (A.BYTES // 2 + 1000) + "\U0001f600" * (A.BYTES // 8)
    x = spark.createDataFrame([(0, text), (1, None)], "k long, text string")
    assert {r.ch: r.n for r in A.char_counts(x, "text").collect()} == Counter(text)
    assert {r.byte: r.n for r in A.byte_counts(x, "text").collect()} == Counter(text.encode())


def test_known_tokens_need_no_python(spark):
    x = spark.createDataFrame([("a b c",), ("",), (None,)], "text string").select(A.known_or(T.words(F.col("text")), ["a", "c"], "?").alias("x"))
    assert [r.x for r in x.collect()] == [["a", "?", "c"], [], None]
    assert "Python" not in x._jdf.queryExecution().executedPlan().toString()


def test_batches_have_a_limit_in_bytes(spark):
    from textquarry.plans.ship import BATCH_BYTES, bound_batches

    bound_batches(spark)
    assert 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES


def test_ids_that_repeat_in_keywords_and_summary(spark):
    """One row an id; rows of one id are counted together. Nothing is shuffled but ids."""
    rows = [(1, "Alpha beta alpha. Gamma the beta beta! Delta."), (1, "delta delta delta beta"), (2, "one"), (3, None), (4, ""), (None, "xyz abc xyz. Abc.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.word, r.n, r["rank"]) for r in E.keywords(df, 3).collect()), key=lambda r: (r[0], r[3]))
    assert got == [(0, "xyz", 1, 1), (0, "abc", 1, 2), (0, "xyz.", 1, 3), (1, "delta", 3, 1), (1, "beta", 3, 2), (1, "alpha", 1, 3), (2, "one", 1, 1)]
    got = {r.doc_id: r.summary for r in E.summary(df, 2).collect()}
    assert set(got) == {1, 2, None} and got[2] == "one" and got[None] == "xyz abc xyz. Abc."
    single = df.where("doc_id > 1")
    for f in (E.keywords, E.summary):
        assert "Exchange hashpartitioning" not in f(single)._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_counted_whole(spark):
    """The vocabulary from pruned candidates is that of all of them, also where words look like tokens."""
    r = random.Random(2)
    words = ["".join(r.choice("abc#") for _ in range(r.randint(1, 12))) for _ in range(300)] + ["##abcab", "##ab"] * 9 + ["xabcab"] * 9 + ["z" * 101]
    df = spark.createDataFrame([(" ".join(words[k::5]),) for k in range(5)], "text string")
    counts = df.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    for size in (5, 60, 400, 10**6):
        want = K.wordpiece_candidates(counts).orderBy(F.desc("n"), F.length("token"), "token").limit(size).collect()
        assert [tuple(x) for x in K.wordpiece_vocabulary(df, size).collect()] == [tuple(x) for x in want]


def test_close_pairs_are_all_of_them(spark):
    """Pairs of sets against brute force: near copies, equal sets, sets of one word, rows without words."""
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    bases = [r.sample(vocab, 30) for _ in range(12)]
    texts = [" ".join(r.sample(b[: 30 - r.randint(0, 6)] + r.sample(vocab, r.randint(0, 6)), 24)) for b in bases for _ in range(9)] + ["one", "One one", "", None, "  ", "one two"] + [" ".join(bases[0])] * 3
    sets = [set((t or "").lower().split()) for t in texts]
    want = {(i, j): round(len(a & b) / len(a | b), 6) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and len(a & b) / len(a | b) >= 0.7}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = D.jaccard_pairs(df, 0.7).collect()
    assert len(rows) == len(want) > 50 and {(x.a, x.b): x.similarity for x in rows} == want
    kept = set()
    for i, a in enumerate(sets):
        if not a or not any((j, i) in want for j in kept):
            kept.add(i)
    assert {x.doc_id for x in D.drop_similar(df, 0.7, exact_greedy=True).collect()} == kept

"""Cleaning, filters, duplicates and samples on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import clean as C, code as K, dedup as D, extract as E, filters as FL, sampling as S, stats


def texts(spark, *rows):
    return spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_clean_order(spark):
    df = texts(spark, "Café &amp; Bar: write to a@b.co or see http://x.y/z now  12.5 $", None, "")
    config = C.CleanConfig(replace_urls=True, replace_emails=True, replace_numbers=True, replace_currency=True, lowercase=True)
    got = {r.doc_id: r.text for r in df.transform(C.clean_text(config)).collect()}
    assert got == {0: "cafe & bar: write to [email] or see [url] now [number] [currency]"}
    kept = df.transform(C.clean_text(config, keep_empty=True)).collect()
    assert [r.text for r in sorted(kept)][1:] == ["", ""]
    punct = C.CleanConfig(replace_urls=True, remove_punctuation=True)
    assert df.transform(C.clean_text(punct)).first().text.count("URL") == 1
    short = C.CleanConfig(min_length=5, max_length=8)
    assert [r.text for r in texts(spark, "abc", "abcdefghijk").transform(C.clean_text(short)).collect()] == ["abcdefgh"]


def test_custom_replacements_and_pipeline(spark):
    df = texts(spark, "a1 b2")
    assert column(df, T.custom_replacements(F.col("text"), [(r"([a-z])(\d)", r"\2\1$")])) == ["1a$ 2b$"]
    out = C.pipeline(df, [C.clean_text(C.CleanConfig(lowercase=True)), lambda x: x.withColumn("text", F.lit(""))])
    assert out.count() == 0


def test_words_split_like_python(spark):
    samples = ["a b c\x1cd", "  x  ", "", "\n\t", "one two\nthree"]
    assert column(texts(spark, *samples), T.words(F.col("text"))) == [s.split() for s in samples]
    assert column(texts(spark, "a\U0001f600ş"), F.size(T.chars(F.col("text")))) == [3]


def test_filter_reasons_in_order(spark):
    df = spark.createDataFrame([(1, "", "en"), (2, None, "en"), (3, "short", "en"), (4, "long enough but one bad word here", "en"), (5, "long enough with nothing wrong in it", "xx"), (6, "long enough with nothing wrong in it", "en"), (7, "many words " * 30, None)], "doc_id long, text string, lang string")
    config = FL.FilterConfig(min_length=10, max_length=200, excluded_words=["BAD"], languages=["en"])
    got = dict(df.select("doc_id", FL.reject_reason(config)).collect())
    assert got == {1: "empty", 2: "empty", 3: "min_length", 4: "excluded_words", 5: "language", 6: None, 7: "max_length"}
    assert {r.reason: r.n for r in FL.reject_stats(df, config).collect()}["kept"] == 1


def test_detect_language(spark):
    df = texts(spark, "the cat is in the house and that was it", "der Hund ist nicht in dem Haus und das ist gut", "kurz", "xqz " * 10)
    assert column(df, FL.detect_language(F.col("text"))) == ["en", "de", "unknown", "unknown"]


def test_dedup_keys(spark):
    df = texts(spark, "A  b", "A b", "a b", "a, b!", "a b ", "other")
    ids = lambda m: sorted(r.doc_id for r in D.dedup(df, m).collect())
    assert ids("exact") == [0, 2, 3, 5] and ids("lowercase") == [0, 3, 5] and ids("normalized") == [0, 5]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_jaccard_pairs_and_minhash_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(200)]
    rows = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(60)]
        for _ in range(r.randint(1, 4)):
            rows.append(" ".join(w if r.random() > 0.04 else r.choice(vocab) for w in base))
    rows += [rows[0]] * 3
    sets = [set(t.split()) for t in rows]
    want = {(i, j) for j in range(len(rows)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.7}
    df = texts(spark, *rows)
    assert {(p.a, p.b) for p in D.jaccard_pairs(df, 0.7).collect()} == want
    found = {(p.a, p.b) for p in D.minhash_pairs(df, 0.7).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)
    dropped = set(range(len(rows))) - {x.doc_id for x in D.drop_similar(df, 0.7).collect()}
    assert dropped == {b for _, b in found} | {len(rows) - 3, len(rows) - 2, len(rows) - 1}
    greedy, kept = set(), {x.doc_id for x in D.drop_similar(df, 0.7, exact_greedy=True).collect()}
    for k in range(len(rows)):
        if not any((i, k) in found for i in greedy):
            greedy.add(k)
    assert kept == greedy


def test_split_and_positions(spark):
    df = spark.range(101).withColumnRenamed("id", "doc_id")
    got = {r.split: r["count"] for r in S.split(df, {"train": 0.8, "valid": 0.1, "test": 0.1}).groupBy("split").count().collect()}
    assert got == {"train": 80, "valid": 10, "test": 11}
    assert [r.position for r in S.with_position(df, ["doc_id"]).orderBy("doc_id").collect()] == list(range(101))
    with pytest.raises(ValueError):
        S.split(df, {"train": 0.8, "test": 0.5}, strict=True)


def test_weighted_sample(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 900, "a").otherwise("b").alias("source"))
    got = S.weighted_sample(df, {"a": 1, "b": 3}, 2000)
    share = got.where("source = 'b'").count() / got.count()
    assert got.count() == 2000 and abs(share - 0.75) < 0.05 and got.join(df, ["doc_id", "source"]).count() == 2000


def test_extract(spark):
    df = texts(spark, "John Smith works for Big Data Inc. He is in Rome. It was 12/03/2020 [1].")
    spans = E.entity_spans(df).collect()
    assert {(s.type, s.text) for s in spans} >= {("PERSON", "John Smith"), ("ORGANIZATION", "Big Data Inc."), ("DATE", "12/03/2020")}
    assert all(df.first().text[s.start : s.end] == s.text for s in spans)
    assert column(df, E.remove_citations(F.col("text")))[0].endswith("12/03/2020 .")
    got = column(texts(spark, "The Automobile, an auto and a CAR."), E.normalize_terms(F.col("text"), {"car": ["car", "automobile", "auto"]}))
    assert got == ["The Car, an car and a CAR."]


def test_code_cleaning(spark):
    py = '#!/usr/bin/env python\nx = 1  # one\n"""doc\nstring"""\ny = "a  b"\n'
    js = "var a = 1; // one\n/* two\nlines */ var b;"
    df = texts(spark, py, js)
    got = column(df, K.clean_code(F.col("text"), F.when(F.col("doc_id") == 0, "python").otherwise("javascript")))
    assert got == ['\nx = 1\n\ny = "a b"\n', "var a = 1;\n var b;"]
    strings = column(texts(spark, 'a = "x\\"y" + \'z\''), K.clean_code(F.col("text"), config=K.CodeConfig(remove_strings=True)))
    assert strings == ['a = "" + ""']
    custom = column(texts(spark, "a ;; gone\n<% b %>c"), K.clean_code(F.col("text"), config=K.CodeConfig(line_prefixes=[";;"], block_pairs=[("<%", "%>")])))
    assert custom == ["a\nc"]


def test_type_hints():
    assert K.strip_type_hints_of("def f(p1: str, p2: int = 10) -> list:\n    pass") == "def f(p1, p2 = 10):\n    pass"
    assert K.strip_type_hints_of("x: int = 1\ns = 'a: b'") == "x = 1\ns = 'a: b'"


def test_statistics(spark):
    df = texts(spark, "a b b", "c", "", None)
    s = stats.dataset_stats(df).first()
    assert s.sample_count == 2 and s.total_words == 4 and s.total_chars == 6
    assert "| 'b' | 2 |" in stats.report(df)
    h = stats.histogram(spark.range(10), F.col("id"), 3).orderBy("bin").collect()
    assert [x.n for x in h] == [3, 3, 4]

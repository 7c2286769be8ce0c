import re

from pyspark.sql import functions as F

from textquarry.llm import toxicity as X

MODEL = X.ToxicityModel({"moron": 4.0, "scum": 2.0, "scumba*": 3.0, "total loser": 5.0}, ("pond scum", "class moron"), 2.0)


def brute(text, model=MODEL):
    """Every entry at every word start, by plain search."""
    t = X.fold(text or "")
    spared = [m.span() for p in model.exceptions for m in re.finditer(f"(?=({re.escape(X.fold(p))}))", t) for m in [re.compile(re.escape(X.fold(p))).match(t, m.start())]]
    best = {}
    for word, weight in model.lexicon.items():
        key = X.fold(word.removesuffix("*")).strip()
        for m in re.finditer(r"(?<= )" + re.escape(key) + ("" if word.endswith("*") else "(?= )"), t):
            if not any(a <= m.start() - 1 < b - 1 for a, b in spared):
                best[m.start()] = max(weight, best.get(m.start(), 0))
    return 100 * sum(best.values()) / (t.count(" ") - 1 + model.length_prior) if best else 0.0


SAMPLES = ["you moron", "you m0r0n!", "Mоrоn", "mo​ron", "ｍｏｒｏｎ", "oxymoron", "pond scum grows", "scum of scum", "a scumbag, scumbags", "scum", "total  loser", "class moron moron", "", "2024 13 100", "moron " * 50 + "fine " * 5000, "$cum"]


def test_folding_and_score_against_brute_force():
    for t in SAMPLES:
        assert abs(MODEL.score(t)[0] - brute(t)) < 1e-9, t
    for t in SAMPLES[:5]:
        assert MODEL.toxic(t), t
    for t in ("oxymoron", "pond scum grows", "", None, "2024 13 100"):
        assert not MODEL.toxic(t), t


def test_rows_and_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "you moron", 2), (2, "", 3), (3, "you moron", 4), (3, "you moron", 4), (4, "fine " * 200_000 + "moron", 5)], "doc_id long, text string, toxic_mark int")
    kept = X.drop_toxic(df, MODEL)
    assert kept.columns == df.columns and sorted((r.toxic_mark) for r in kept.collect()) == [1, 3, 5]
    got = X.score_toxicity(df, MODEL).collect()
    assert len(got) == 6 and [r.toxic for r in got if r.doc_id == 3] == [True, True]
    empty = spark.createDataFrame([], df.schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = X.fit(empty, labels)
    assert model.threshold == X.DEFAULT_THRESHOLD and X.score_toxicity(empty, model).count() == 0 and X.drop_toxic(empty, model).count() == 0


def test_query_on_held_out_labels(spark):
    """The lexicon is fitted on one half of the labels and judged on the other."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    model = X.fit(docs, labels.where(half == 0))
    got = X.score_toxicity(docs, model).join(labels.where(half == 1).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    bad = sum(r.y for r in got)
    hit = sum(r.toxic and r.y == 1 for r in got)
    wrong = sum(r.toxic and r.y == 0 for r in got)
    assert bad > 3 and hit >= 0.8 * bad and wrong <= 0.02 * (len(got) - bad) + 1


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = X.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = X.op4_toxicity(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id], model)
        assert abs(r.score - want) < 1e-5 and r.toxic == (want >= model.threshold)

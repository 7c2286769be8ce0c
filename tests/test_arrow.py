"""Functions over Arrow batches against plain Python."""

import random
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.functions import arrow as A, text as T, unicode as U
from textquarry.operators import bpe_training as B, clean as C, dedup as D, filters as FL, metrics as M, tokenizers as K
from textquarry.sources import writers as WR

TEXTS = ["Ünïcode ﬁne ① café &amp; caf\u0065\u0301", "plain ascii &lt;b&gt;", "", None, "\U0001f600 smile\x07\u200d", "über-straße " * 30]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


def column(df, expression):
    return [r.x for r in df.select("doc_id", expression.alias("x")).orderBy("doc_id").collect()]


def test_counts(spark, df):
    whole = "".join(t for t in TEXTS if t)
    assert {r.ch: r.n for r in A.char_counts(df, "text").collect()} == Counter(whole)
    assert {r.byte: r.n for r in A.byte_counts(df, "text").collect()} == Counter(whole.encode())
    pieces = spark.createDataFrame([("aab", 2), ("é", 3), ("b", 1), ("", 4)], "piece string, n long")
    assert {(r.left, r.right): r.n for r in A.pair_counts(pieces).collect()} == {(97, 97): 2, (97, 98): 2, (0xC3, 0xA9): 3}
    empty = spark.createDataFrame([], "doc_id long, text string, piece string, n long")
    assert A.char_counts(empty, "text").count() == A.byte_counts(empty, "text").count() == A.pair_counts(empty).count() == 0


def test_pieces_and_joins(df):
    upper = A.by_piece("array<string>", lambda w: [w.upper(), "|"] if w else [])
    assert column(df, upper(T.words(F.col("text")))) == [None if t is None else [x for w in t.split() for x in (w.upper(), "|")] for t in TEXTS]
    tokens = {0: b"a", 1: b"\xc3", 2: b"\xa9"}
    x = df.select("doc_id", F.when(F.col("doc_id") == 3, None).when(F.col("doc_id") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(9), F.lit(-1))).alias("ids"))
    assert column(x, A.join_tokens(tokens, b"?")(F.col("ids"))) == ["aé??", "a\ufffd", "aé??", None, "aé??", "aé??"]


@pytest.mark.parametrize("rule", ("nfc", "nfkc", "nfkd", "nmt_nfkc"))
def test_unicode_forms(df, rule):
    form = {"nmt_nfkc": "NFKC"}.get(rule, rule.upper())
    want = [None if t is None else unicodedata.normalize(form, t) for t in TEXTS]
    if rule == "nmt_nfkc":
        want = [None if t is None else "".join(c for c in t if unicodedata.category(c)[0] != "C") for t in want]
    assert column(df, U.normalize(F.col("text"), rule)) == want


def test_fix(df):
    import html

    def slow(t, entities, nfc, accents):
        t = html.unescape(t) if entities else t
        t = unicodedata.normalize("NFC", t) if nfc else t
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) if accents else t

    for on in ((True, True, True), (True, True, False), (False, False, True), (False, True, False)):
        assert column(df, U.fix(F.col("text"), *on)) == [None if t is None else slow(t, *on) for t in TEXTS]


def test_cleaning_runs_once(df):
    """One Python step, and each regular expression of the chain once: the length rules read the result."""
    config = C.CleanConfig(replace_emails=True, replace_currency=True, lowercase=True, min_length=5, max_length=50)
    plan = df.transform(C.clean_text(config))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("[EMAIL]") == 1 and plan.count("[CURRENCY]") == 1
    got = {r.doc_id: r.text for r in df.transform(C.clean_text(config)).collect()}
    assert set(got) == {0, 1, 4, 5} and max(map(len, got.values())) == 50


@pytest.mark.parametrize("seed", range(3))
def test_distributed_merges_are_the_drivers(spark, seed):
    r = random.Random(seed)
    rows = Counter("".join(r.choice("aabcd") for _ in range(r.randint(2, 9))) for _ in range(400))
    pieces = spark.createDataFrame(list(rows.items()), "piece string, n long").repartition(3)
    table = pa.table({"piece": list(rows), "n": list(rows.values())})
    merges = B.on_driver(table, 25, 2)
    assert len(merges) == 25 and B.train(pieces, 25, 2, driver_bytes=0) == merges == B.train(pieces, 25, 2)


def test_bpe_pieces_against_slow_merging():
    r = random.Random(4)
    letters = [bytes([b]) for b in b"abc"]
    merges = []
    for _ in range(12):
        p = (r.choice(letters), r.choice(letters))
        if p not in merges:
            merges.append(p)
            letters.append(p[0] + p[1])
    model = K.Bpe(merges)
    for _ in range(300):
        piece = "".join(r.choice("abc") for _ in range(r.randint(0, 20)))
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            found = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert model.piece(piece) == [model.ids[p] for p in parts]


def test_every_model_is_saved(spark, df, tmp_path):
    text = df.where("text is not null")
    models = [K.ByteLevel(300), K.Bpe.train(text, 10), K.WordPiece.train(text, 50), K.Unigram.train(text, 40, 2)]
    models.append(K.Mixed({"byte": models[0], "bpe": models[1]}, K.language_router({"en": "bpe"}, "byte"), "byte"))
    for k, model in enumerate(models):
        WR.model(spark, model, str(tmp_path / str(k)))
        again = WR.load_model(spark, str(tmp_path / str(k)))
        assert again.save() == model.save() and again.vocabulary(spark).count() == model.vocabulary(spark).count()
    with pytest.raises(ValueError):
        K.Mixed({"byte": models[0]}, lambda t: F.lit("byte"), "byte").save()


def test_language_router(spark):
    x = spark.createDataFrame([("the cat is in the house and that was it",), ("der Hund ist nicht in dem Haus und das",), ("",), (None,)], "text string")
    assert [r[0] for r in x.select(K.language_router({"en": "a", "de": "b"}, "c")(F.col("text"))).collect()] == ["a", "b", "c", "c"]
    assert [r[0] for r in x.limit(0).select(FL.detect_language(F.col("text"))).collect()] == []


def test_hot_groups_of_similar_texts(spark):
    """Many near copies of one text, and others that only share a band's worth of words."""
    r = random.Random(9)
    vocab = [f"w{k}" for k in range(300)]
    base = r.sample(vocab, 60)
    rows = [" ".join(base[:-1] + [f"x{k}"]) for k in range(150)] + [" ".join(base[:20] + r.sample(vocab, 40)) for _ in range(40)]
    r.shuffle(rows)
    sets = [set(t.split()) for t in rows]
    near = lambda a, b: len(a & b) / len(a | b) >= 0.85
    want = {j for j in range(len(rows)) if not any(near(sets[i], sets[j]) for i in range(j))}
    got = {x.doc_id for x in D.drop_similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 0.85).collect()}
    assert got == want


def test_files_by_suffix(spark):
    x = spark.createDataFrame([("a/b.py", "x = 1  # one\n"), ("c.txt", "Café  bar"), ("d.css", "/* only */")], "path string, text string")
    assert {r.path: r.text for r in x.transform(C.clean_by_suffix).collect()} == {"a/b.py": "x = 1\n", "c.txt": "Cafe bar"}


def test_speed_and_round_trip(df):
    model = K.ByteLevel()
    got = M.speed(df, model.encode, model.decode, repeats=1)
    assert got["chars"] == sum(len(t) for t in TEXTS if t) and got["encode_tokens_per_second"] > 0 and got["decode_seconds"] > 0
    x = df.where("text is not null").withColumn("kind", F.when(F.col("doc_id") < 2, "a").otherwise("b"))
    rows = {r.category: (r.texts, r.exact_percent) for r in M.roundtrip(x, model.encode, model.decode, "kind").collect()}
    assert rows == {"a": (2, 100.0), "b": (3, 100.0), None: (5, 100.0)}

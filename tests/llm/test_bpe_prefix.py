import random

import pytest
from pyspark.sql import functions as F

from textquarry.llm import bpe_prefix as X
from textquarry.llm._vocab import encoding

ALPHABET = "abcdefg hijklm  nopqrst\n\n\tuvwxyz'ABC0123456789.,!?-äöüßéñışğ中文字\U0001f600 ​é"


def sample(r, n):
    return "".join(r.choice(ALPHABET) for _ in range(n))


def test_same_ids_as_tiktoken():
    r, enc, model = random.Random(1), encoding(), X.bpe()
    for k in range(1500):
        t = sample(r, r.randint(0, 60))
        ids = model.encode(t)
        assert ids == enc.encode_ordinary(t), t
        assert model.decode(ids) == t


def test_prefix_table_against_fresh_encodings():
    r, model, enc = random.Random(2), X.bpe(), encoding()
    for _ in range(200):
        data = sample(r, 25).encode()
        last = []
        for end in range(0, len(data), 3):
            model.extend(data[:end], last)
            assert model.walk(last) == enc._core_bpe.encode_single_piece(data[:end]) if end else last == []


def test_edits_against_fresh_encodings():
    r, model = random.Random(3), X.bpe()
    for _ in range(60):
        text = sample(r, 80)
        p = X.PrefixText(model, text)
        for _ in range(12):
            at, cut, new = r.randint(0, len(text)), r.randint(0, 6), sample(r, r.randint(0, 6))
            p.edit(at, cut, new)
            text = text[:at] + new + text[at + cut :]
            assert p.text == text and p.ids() == model.encode(text)
        p.append(" more")
        assert p.ids() == model.encode(text + " more")


def test_an_edit_touches_little():
    p = X.PrefixText(X.bpe(), "some ordinary words in a row " * 2000)
    p.work = 0
    p.edit(30_000, 3, "xyz")
    assert p.work < 60


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 100_000)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, token_ids array<int>")
    got = {x.doc_id: x for x in X.encode_table(df).collect()}
    assert got[1].ids is None and got[1].n_tokens is None and got[2].ids == [] and got[2].exact and got[None].n_tokens == 1 and got[4].exact
    out = X.encode_documents(df)
    assert out.columns == [*df.columns, "token_ids_"]
    back = X.decode_table(out, ids_col="token_ids_", text_col="back")
    assert back.where(~F.col("back").eqNullSafe(F.col("text"))).count() == 0
    assert X.encode_table(spark.createDataFrame([], df.schema)).count() == 0
    with pytest.raises(ValueError):
        X.bpe().decode([10**6])
    assert X.bpe().decode([X.bpe().ranks[b"\xff"]]) == "�"


def test_query_against_tiktoken(spark, sf_dir):
    enc = encoding()
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = X.op8_bpe_prefix(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for x in got:
        assert x.ids == enc.encode_ordinary(texts[x.doc_id]) and x.exact and x.n_tokens == len(x.ids)


def test_edits_of_a_table(spark):
    enc, r = encoding(), random.Random(6)
    texts = [None, "", "short text", "word " * 3000, "über alles 12345 \u4e00\u4e01  \n\n x"]
    edits = [[(3, 1, "x")], [(0, 0, "new text")], None, [(7000, 5, "other"), (None, None, " end"), (0, 1, "")], [(10**6, 4, "?"), None, (-3, 2, "")]]
    df = spark.createDataFrame([(i, t, e, "x") for i, (t, e) in enumerate(zip(texts, edits))], "doc_id long, text string, edits array<struct<at:int,remove:int,insert:string>>, ids string")
    got = {x.doc_id: x for x in X.edit_table(df).collect()}
    want = {0: None, 1: "new text", 2: "short text", 3: (lambda t: t[1:])("word " * 1400 + "other" + "word " * 1599 + " end"), 4: texts[4][2:] + "?"}
    assert {i: x.text for i, x in got.items()} == want
    assert all(x.ids == (None if x.text is None else enc.encode_ordinary(x.text)) for x in got.values())
    assert got[3].encoded_bytes < 200 and got[2].encoded_bytes == 0
    assert X.edit_table(df.limit(0)).count() == 0


def test_query_conversations(spark, sf_dir):
    """The whole table, turn by turn, against a fresh encoding of the conversation so far."""
    enc, so_far = encoding(), {}
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    got = {(x.conv_id, x.turn): x for x in X.bpe_prefix_conversations(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    ids = {}
    for x in sorted(rows, key=lambda x: (x.conv_id, x.turn)):
        so_far[x.conv_id] = so_far[x.conv_id] + "\n" + x.text if x.conv_id in so_far else x.text
        g = got[x.conv_id, x.turn]
        ids[x.conv_id] = ids.get(x.conv_id, [])[: g.kept] + g.new_ids
        assert ids[x.conv_id] == enc.encode_ordinary(so_far[x.conv_id]) and g.n_tokens == len(ids[x.conv_id])
    assert sum(x.kept for x in got.values()) > 0

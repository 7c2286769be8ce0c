import hashlib
import re

import corpus_pipeline as P
from tests.llm import test_mixing, test_simhash
from textquarry.llm import mixing, toxicity
from textquarry.llm._vocab import encoding
from textquarry.llm.secret_scan import find_secrets

ORDER = ["toxicity", "simhash_near_dedup", "secret_scan", "mixing", "bpe_encode"]


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    """Each stage on what the one before kept, document by document."""
    assert [n for n, _ in P.STAGES] == ORDER
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    enc, columns = encoding(), docs.columns
    rows = {x.doc_id: x for x in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.columns[: len(columns)] == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {x.doc_id: x for x in docs.collect()}
        texts = {i: x.text for i, x in rows.items()}
        if name == "toxicity":
            assert set(got) == {i for i, t in texts.items() if not model.toxic(t)} != set(texts)
        elif name == "simhash_near_dedup":
            edges, group = test_simhash.brute_groups(texts)
            gone = set(texts) - set(got)
            assert gone and gone <= {i for i in texts if group[i] != i}
            assert len(gone) >= 0.95 * sum(group[i] != i for i in texts)
        elif name == "secret_scan":
            assert set(got) == set(texts)
            for i, t in texts.items():
                for a, b, _ in reversed(find_secrets(t, enc)):
                    t = t[:a] + "[SECRET]" + t[b:]
                assert got[i].text == t and got[i].n_chars == len(t)
        elif name == "mixing":
            want = test_mixing.brute([(i, x.text, x.source) for i, x in rows.items()], mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, share=P.BUDGET_SHARE)
            assert set(got) == {w[0] for w in want} and len(got) < len(texts)
        else:
            assert set(got) == set(texts) and all(x.token_ids == enc.encode_ordinary(x.text) for x in got.values())
        rows = got
    final = P.run(spark, sf_dir).collect()
    assert sorted(final) == sorted(rows.values())


def test_odd_documents(spark, tmp_path):
    """Nulls, empty, long and repeated rows, columns with names that the stages use, and an empty table pass all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, token_ids string, bucket int, __tie string, id long, toxic_mark string"
    rows = [(1, None, None, None, None), (None, "text without an id", "en", "s", 18), (2, "", "en", "s", 0), (3, "a plain text", "en", None, 12), (3, "a plain text", "en", None, 12), (4, "word " * 50_000, "en", "s", 250_000)]
    for name, data in (("some", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame([(*r, "t", k, "u", k, "v") for k, r in enumerate(data)], schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out = P.run(spark, d)
        assert out.columns[:-1] == [c.split()[0] for c in schema.split(", ")]
        got = sorted((x.doc_id, x.token_ids, x.bucket, x[-1] == []) for x in out.collect())
        # The long text would pass the budget of 80 % of the tokens.
        assert got == ([(2, "t", 2, True), (3, "t", 3, False), (3, "t", 4, False)] if data else [])


def test_hash_order_is_known():
    assert re.fullmatch("[0-9a-f]{32}", hashlib.md5(b"42:1").hexdigest())

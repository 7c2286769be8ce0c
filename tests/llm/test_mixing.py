import hashlib
import random
import re

from textquarry.llm import mixing as X

SCHEMA = "doc_id long, text string, source string, bucket string, key int, mix_id int"


def brute(rows, weights, default, budget=None, share=None, seed=X.SEED):
    """Documents one by one, in order of finish time."""
    queues = {}
    for i, t, s in rows:
        if i is None or t is None:
            continue
        s = s or ""
        if weights.get(s, default) > 0:
            queues.setdefault(s, []).append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, hashlib.md5(t.encode()).hexdigest(), len(re.findall(r"[^ \t\n\r\f]+", t))))
    timed, total = [], 0
    for s, q in queues.items():
        n = 0
        for key, i, tie, tokens in sorted(q):
            n += tokens
            timed.append((n / weights.get(s, default), s, key, i, tie, tokens))
        total += n
    limit = budget if budget is not None else int(share * total)
    out, n = [], 0
    for finish, s, key, i, tie, tokens in sorted(timed):
        n += tokens
        if n <= limit:
            out.append((i, s, tokens, round(finish, 6), n))
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(r.randrange(400), " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 60))), r.choice(["a", "a", "a", "b", "c", None, "zero"])) for _ in range(500)]
    rows += [rows[3]] * 5 + [(None, "x y", "a"), (1000, None, "b"), (1001, "", "c")]
    df = spark.createDataFrame([(*x, "k", 1, 2) for x in rows], SCHEMA)
    weights = {"a": 1.0, "b": 3.0, "c": 0.5, "zero": 0.0}
    want = sorted(brute(rows, weights, 1.0, budget=4000))
    assert rows_of(X.mix_schedule(df, weights=weights, budget=4000)) == want
    assert rows_of(X.mix_schedule(df, weights=weights, budget_share=0.5)) == sorted(brute(rows, weights, 1.0, share=0.5))


def test_shares_follow_weights(spark):
    df = spark.createDataFrame([(k, "one two three four", "a" if k < 3000 else "b", "", 0, 0) for k in range(4000)], SCHEMA)
    got = X.mix_schedule(df, weights={"a": 1.0, "b": 2.0}, budget=6000).collect()
    b = sum(x.n_tokens for x in got if x.source == "b")
    assert max(x.running_tokens for x in got) <= 6000 and abs(b / 6000 - 2 / 3) < 0.01


def test_documents_and_edges(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (None, "c", "s"), (3, "", None), (4, "word " * 100_000, "t")]
    df = spark.createDataFrame([(*x, "k", 1, 2) for x in rows], SCHEMA)
    out = X.mix_documents(df, budget=10)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == [1, 1, 3]
    assert X.mix_documents(df, budget=10**9).count() == 4
    assert X.mix_documents(df, budget=0).count() == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert X.mix_schedule(empty).count() == 0 and X.mix_documents(empty).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    want = brute([tuple(x) for x in docs], X.WEIGHTS, X.DEFAULT_WEIGHT, share=X.BUDGET_SHARE)
    assert rows_of(X.op7_mixing(spark, sf_dir)) == sorted(want) != []

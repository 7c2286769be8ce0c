import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import block_anchors as B
from textquarry.llm._util import code_points, word_hashes, word_spans

SCHEMA = "doc_id long, text string, bucket int, ids string"


def words(t):
    return t.split()


def brute(rows, m):
    """Word positions of each document that lie in an m-word run that occurs again."""
    seen = {}
    for i, t in rows.items():
        w = words(t)
        for p in range(len(w) - m + 1):
            seen.setdefault(tuple(w[p : p + m]), []).append((i, p))
    covered = {}
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                covered.setdefault(i, set()).update(range(p, p + m))
    return covered


def check(spark, rows, block, m):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    one = {}
    for i, t in rows:
        if i is not None and t is not None:
            one[i] = min(t, one.get(i, t))
    got = B.repeats(df, block, m).collect()
    covered = {}
    for r in got:
        a, b = words(one[r.doc_id]), words(one[r.other_id])
        assert r.n_words >= m and (r.doc_id, r.start_word) != (r.other_id, r.other_start)
        assert a[r.start_word : r.start_word + r.n_words] == b[r.other_start : r.other_start + r.n_words]
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert covered == brute(one, m)
    return got


def test_word_spans_match_split():
    t = " a b\t\tc　d\x1ce  "
    cp = code_points(t)
    assert [t[a:b] for a, b in zip(*word_spans(cp))] == t.split()
    t = "ab 日本 c日d 本"
    assert [t[a:b] for a, b in zip(*word_spans(code_points(t)))] == ["ab", "日", "本", "c", "日", "d", "本"]
    h = word_hashes(code_points("aa bb aa"), np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert h[0] == h[2] != h[1]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [text(r.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = text(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            p, at = r.choice(passages), r.randint(0, len(w))
            cut = r.randint(0, 3)
            w[at:at] = p[cut:]
        rows.append((i * 7 - 100, r.choice([" ", "\n", "  "]).join(w)))
    rows += [(1000 + k, rows[5][1]) for k in range(20)]
    assert check(spark, rows, 4, 9)


def test_edges(spark):
    long = " ".join(f"a{i}" for i in range(4000))
    p = " ".join(f"p{i}" for i in range(12))
    rows = [(1, None), (None, p), (2, ""), (3, p), (3, p), (4, "x " + p), (5, long), (6, p + " y " + p), (7, long[:-10]), (8, "short")]
    got = check(spark, rows, 4, 8)
    assert {r.doc_id for r in got} == {3, 4, 5, 6, 7}
    empty = spark.createDataFrame([], SCHEMA)
    assert B.repeats(empty).count() == 0
    assert B.repeats(spark.createDataFrame([(1, p, 0, ""), (1, p, 0, "")], SCHEMA), 4, 8).count() == 0
    with pytest.raises(ValueError):
        B.repeats(empty, 25, 40)


def test_cut(spark):
    p = " ".join(f"p{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"a {p} b", 0, ""), (2, f"c {p} d", 0, ""), (3, None, 0, ""), (4, "", 0, "")], SCHEMA)
    got = {r.doc_id: r.text for r in B.cut_repeats(df, block=4, min_words=8).collect()}
    assert got == {1: f"a {p} b", 2: "c  d", 3: None, 4: ""}


def test_query_matches_brute_force(spark, sf_dir):
    got = B.op10_block_anchors(spark, sf_dir)
    covered = {}
    for r in got.collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull()).collect()}
    assert covered == brute(rows, B.MIN_WORDS) != {}

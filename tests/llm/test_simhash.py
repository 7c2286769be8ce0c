import random

import numpy as np
import pytest

from textquarry.llm import simhash_anchors as S

SCHEMA = "doc_id long, text string, anchor int, fp string"


def test_covering_code():
    errors, words = S.golay()
    assert len(set(words.tolist())) == 4096 and (np.bitwise_count(errors) <= 3).all()
    assert np.bitwise_count(words[words > 0]).min() == 7
    x = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    home = x ^ errors[S.syndrome(x)]
    assert set(home.tolist()) <= set(words.tolist())
    offsets, near = S.reach(1)
    for v, h in zip(x[:200].tolist(), home[:200].tolist()):
        s = int(S.syndrome(np.array([v]))[0])
        anchors = set((h ^ near[offsets[s] : offsets[s + 1]]).tolist())
        assert anchors == {int(w) for w in words if (v ^ int(w)).bit_count() <= 4}


def text(r, n, vocab=3000):
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def distance(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b))


def test_candidates_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for _ in range(60):
        base = text(r, r.randint(20, 200))
        for _ in range(3):
            rows.append([w if r.random() > 0.06 else f"x{r.random()}" for w in base])
    fps = [S.fingerprint(" ".join(w))[1] for w in rows]
    want = {(i, j) for j in range(len(rows)) for i in range(j) if distance(fps[i], fps[j]) <= S.MAX_DISTANCE}
    near = {(i, j) for i, j in want if distance(fps[i], fps[j]) < 2 * S.BLOCKS}
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp array<int>")
    got = {(p.a, p.b) for p in S.candidate_pairs(df).collect()}
    assert got <= want and near <= got and len(got) >= 0.9 * len(want)


def components(edges, ids):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)]
    want = components(edges, {i for e in edges for i in e})
    got = {x.id: x.group for x in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: g for i, g in want.items() if any(i in e and e[0] != e[1] for e in edges)}


def brute_groups(texts):
    """All pairs of documents by distance and by similarity of their sketches."""
    f = {i: S.fingerprint(t) for i, t in texts.items()}

    def similar(a, b):
        union = sorted(set(a) | set(b))[: S.SKETCH]
        return sum(x in set(a) and x in set(b) for x in union) / len(union)

    ids = sorted(texts)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if f[a][0] == f[b][0] or (distance(f[a][1], f[b][1]) <= S.MAX_DISTANCE and similar(f[a][2], f[b][2]) >= S.MIN_JACCARD)]
    return edges, components(edges, ids)


def test_query_against_brute_force(spark, sf_dir):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    edges, want = brute_groups(texts)
    got = {x.doc_id: x.keep_id for x in S.op2_simhash(spark, sf_dir).collect()}
    assert edges and sum(got.get(a, a) == got.get(b, b) for a, b in edges) >= 0.95 * len(edges)
    assert all(want[i] == want[g] for i, g in got.items())


@pytest.mark.parametrize("shuffled", [False, True])
def test_edges(spark, shuffled):
    r = random.Random(7)
    base = text(r, 120)
    near = base[:60] + ["changed"] + base[61:]
    long = text(r, 60_000)
    rows = [(5, " ".join(base)), (6, " ".join(near)), (7, " ".join(base).upper() + "!"), (8, None), (None, " ".join(base)), (9, ""), (10, ""), (11, "..."), (12, "!!!"), (13, "..."), (14, "one"), (15, " ".join(long)), (16, " ".join(long[:-20])), (17, "lone words here"), (17, "lone words here")]
    rows = [(i, t, 1, "x") for i, t in rows]
    if shuffled:
        r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x.keep_id for x in S.near_duplicate_groups(df).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 9: 9, 10: 9, 11: 11, 13: 11, 15: 15, 16: 15}
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((x.doc_id for x in kept.collect() if x.doc_id is not None)) == [5, 8, 9, 11, 12, 14, 15, 17, 17]
    assert kept.where("doc_id is null").count() == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicate_groups(empty).count() == 0 and S.drop_near_duplicates(empty).count() == 0


def test_many_copies(spark):
    df = spark.createDataFrame([(i, "the very same text in every row", 0, "") for i in range(3000)] + [(5000, "another one that nobody repeats", 0, "")], SCHEMA)
    assert sorted(x.doc_id for x in S.drop_near_duplicates(df).collect()) == [0, 5000]


def test_split_anchors_agree(spark, monkeypatch):
    r = np.random.default_rng(8)
    base = r.integers(0, 1 << 23, (3, S.BLOCKS))
    fps = [(int(i), (base[i % 3] ^ np.where(r.random(S.BLOCKS) < 0.4, 1 << r.integers(0, 23, S.BLOCKS), 0)).tolist()) for i in range(300)]
    df = spark.createDataFrame(fps, "id long, fp array<int>").repartition(3)
    pairs = lambda: sorted(tuple(p) for p in S.candidate_pairs(df).collect())
    whole = pairs()
    monkeypatch.setattr(S, "SPLIT", 20)
    assert len(whole) > 5000 and pairs() == whole

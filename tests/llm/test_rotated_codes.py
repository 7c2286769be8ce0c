import numpy as np

from textquarry.llm import rotated_codes as X

SCHEMA = "vec_id long, embedding array<float>, band int, code string"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = unit(rng.standard_normal((400, 64)))
    y = unit(x + 0.06 * rng.standard_normal(x.shape))
    sign, f, *_ = X.encode(X.rotate(x, 0, 1, 3), np.arange(400))
    _, _, q, low, step = X.encode(X.rotate(y, 0, 1, 3), np.arange(400, 800))
    s = (sign * 2.0 - 1) / np.sqrt(64)
    v = q * step[:, None] + low[:, None]
    error = (s * v).sum(1) / f - (x * y).sum(1)
    assert abs(error.mean()) < 3 * error.std() / np.sqrt(400) + 0.005
    assert (np.abs(error) <= X.bounds(f, 64)).mean() > 0.98


def cosines(vectors):
    ids = sorted(vectors)
    m = unit(np.array([vectors[i] for i in ids], np.float64))
    c = m @ m.T
    return {(ids[i], ids[j]): c[i, j] for i in range(len(ids)) for j in range(i + 1, len(ids)) if c[i, j] >= X.MIN_COSINE}


def held(got, vectors, copies_of=None):
    """Against all pairs: copies are paired with their smallest id only."""
    want = cosines(vectors)
    first, seen = {}, {}
    for i in sorted(vectors):
        first[i] = seen.setdefault(tuple(vectors[i]), i)
    stars = {(a, b) for a, b in want if first[a] == a and first[b] in (a, b)}
    pairs = {(r.a, r.b): r for r in got}
    assert len(pairs) == len(got)
    found = stars & set(pairs)
    assert len(found) >= 0.9 * len(stars)
    m = {i: unit(np.array(v, np.float64)) for i, v in vectors.items()}
    for (a, b), r in pairs.items():
        true = float(m[a] @ m[b])
        assert true >= X.MIN_COSINE - (1e-4 if r.recomputed else 0.08)
        if r.recomputed:
            assert abs(r.similarity - true) < 1e-4
    return stars


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 48))
    vectors = {}
    for k, b in enumerate(base):
        for _ in range(rng.integers(1, 5)):
            vectors[len(vectors) * 3 - 20] = (unit(b) + rng.uniform(0, 0.07) * rng.standard_normal(48)).astype(np.float32).tolist()
    for i in list(vectors)[:4]:
        vectors[max(vectors) + 1] = vectors[i]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], SCHEMA).repartition(3)
    assert held(X.near_pairs(df).collect(), vectors)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [1.0, 2.0]), (4, None), (None, [1.0, 2.0, 3.0]), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [None, 1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = {(r.a, r.b): r.similarity for r in X.near_pairs(df).collect()}
    assert set(got) == {(1, 2), (1, 10), (1, 11)} and all(abs(s - 1) < 0.05 for s in got.values())
    assert X.near_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 0.5], 1, "") for i in range(2000)], SCHEMA)
    assert X.near_pairs(same).count() == 1999


def test_large_and_small_bands_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((5, 32))
    rows = [(i, (unit(centre[i % 5]) + 0.05 * rng.standard_normal(32)).astype(np.float32).tolist(), 1, "") for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = lambda: sorted(tuple(r) for r in X.near_pairs(df).collect())
    small = pairs()
    monkeypatch.setattr(X, "_FEW", 1)
    assert small == pairs() and held(X.near_pairs(df).collect(), {r[0]: r[1] for r in rows})


def test_split_bands_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((2, 32))
    df = spark.createDataFrame([(i, (unit(centre[i % 2]) + 0.04 * rng.standard_normal(32)).astype(np.float32).tolist(), 1, "") for i in range(400)], SCHEMA)
    pairs = lambda: sorted(tuple(r) for r in X.near_pairs(df).collect())
    whole = pairs()
    monkeypatch.setattr(X, "SPLIT", 30)
    assert whole and whole == pairs()


def test_bands_follow_the_number_of_vectors():
    assert X.band_plan(51_282) == (24, 14)
    for n in (0, 1, 500, 10**6, 10**9):
        bands, bits = X.band_plan(n)
        assert 1 - (1 - (1 - np.arccos(X.MIN_COSINE) / np.pi) ** bits) ** bands >= X.RECALL
        assert n / 2**bits <= 8
    assert X.band_plan(10**9)[0] < 12 * X.band_plan(51_282)[0]


def test_long_vectors_are_turned_too():
    x = unit(np.random.default_rng(7).standard_normal((6, 3000)))
    y = X.rotate(x, 1, 2, 5)
    assert y.shape == (6, 4096) and np.allclose(y @ y.T, x @ x.T) and abs(y.mean()) < 0.01


def test_extreme_vectors(spark):
    rows = [(1, [1e-30, 2e-30]), (2, [1e30, 2e30]), (3, [1.0, 0.1] * 20_000), (4, [1.0, 0.1] * 20_000), (5, [1.0])]
    got = {r.vec_id: r[1:] for r in X.near_classes(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)).collect()}
    assert got == {1: (1, 1, 1), 2: (2, 1, 1), 3: (3, 0, 3), 4: (3, 0, 3), 5: (5, 0, 5)}


def brute_classes(vectors):
    """Of each id: its class, the exact number of linked classes, the group."""
    first, seen = {}, {}
    for i in sorted(vectors):
        first[i] = seen.setdefault(tuple(vectors[i]), i)
    pairs = cosines({i: vectors[i] for i in set(first.values())})
    up = {i: i for i in first.values()}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    links = {i: sum(i in p for p in pairs) for i in up}
    return {i: (c, links[c], root(c)) for i, c in first.items()}


def test_query_against_brute_force(spark, sf_dir, tmp_path):
    """The whole table, with noisy and exact copies of its vectors put in: it has no near pairs of its own."""
    rng = np.random.default_rng(5)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    for i, v, label in rows[:150]:
        noisy = unit(np.array(v)) + rng.uniform(0, 0.06) * rng.standard_normal(len(v))
        rows.append((10_000 + i, [float(x) for x in noisy.astype(np.float32)], label))
        rows.append((20_000 + i, v, label))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.class_id, r.links, r.group_id) for r in X.op9_rotated_codes(spark, str(tmp_path)).collect()}
    want = brute_classes({r[0]: r[1] for r in rows})
    assert set(got) == set(want) and all(got[i][0] == want[i][0] and got[i][1] <= want[i][1] + 1 for i in want)
    assert sum(g[1] for g in got.values()) >= 0.9 * sum(w[1] for w in want.values()) > 100
    assert np.mean([got[i][2] == want[i][2] for i in want]) > 0.95

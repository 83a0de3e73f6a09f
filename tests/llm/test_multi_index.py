"""The inverted multi-index against brute force."""

import pytest

np = pytest.importorskip("numpy")
F = pytest.importorskip("pyspark.sql.functions")
index = pytest.importorskip("tallyforge.llm.multi_index")


def brute(x, ids, own, q, k):
    s = x @ q
    order = sorted((i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-s[i], ids[i]))
    return [(int(ids[i]), s[i]) for i in order[:k]]


def recall_on(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in index.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hits = 0
    for own, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and own not in [f[1] for f in found]
        q = x[list(ids).index(own)]
        for _, v, s in found:
            assert abs(x[list(ids).index(v)] @ q - s) < 1e-12
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({f[1] for f in found} & {b[0] for b in brute(x, ids, own, q, 20)})
    return hits / (20 * len(got))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    assert recall_on(spark, f"/root/testdata/{sf}") >= 0.9


def test_an_id_of_another_name(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 30)], "key long, v array<double>")
    got = index.search(df, F.col("key") == 7, k=3, id_col="key", vec_col="v", recall=1.0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(7, 29, 204.0), (7, 28, 197.0), (7, 27, 190.0)]


def test_the_walk_is_in_order():
    rng = np.random.default_rng(5)
    s1, s2, counts = rng.normal(size=9), rng.normal(size=9), rng.integers(0, 3, 81)
    cells = index.walk(s1, s2, counts, 10**9)
    pair = (s1[:, None] + s2[None, :]).ravel()
    assert cells == [c for c in np.argsort(-pair).tolist() if counts[c]]


def test_odd_vectors_ties_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(index, "PART", 64)
    monkeypatch.setattr(index, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(2)
    common = rng.normal(size=6)
    rows = [(i, (common if i % 3 else rng.normal(size=6)).tolist(), i) for i in range(1, 600)]
    rows += [(600, None, 0), (620, [0.0] * 6, 0), (640, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (660, [float("nan")] * 6, 0), (680, [1.0], 0)]
    rows += [(None, [1.0] * 6, 0), (700, [1.0] * 6, 0), (700, [1.0] * 6, 0), (720, [float("inf")] + [0.0] * 5, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    monkeypatch.setattr(index, "RECALL", 1.0)
    got = {}
    for r in index.search(df, F.col("vec_id") % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    good = [(i, v) for i, v, _ in rows if i and v and len(v) == 6 and None not in v and np.isfinite(v).all() and any(v)]
    x, ids = np.array([v for _, v in good]), np.array([i for i, _ in good])
    assert sorted(got) == sorted({i for i, _ in good if i % 20 == 0})
    hits = total = 0
    for own, found in got.items():
        want = [i for i, _ in brute(x, ids, own, x[list(ids).index(own)], 20)]
        hits, total = hits + len(set(want) & set(found)), total + len(want)
    assert hits / total > 0.97
    assert index.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(20, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in index.search(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(20, 1, 1.0), (20, 2, 1.0)]

"""The factorisation machine: the identity against all pairs, held-out accuracy, odd rows."""

import itertools
import zlib

import pytest

np = pytest.importorskip("numpy")
quality = pytest.importorskip("tallyforge.llm.quality")
SF = "/root/testdata/sf0.01"


def test_linear_time_equals_all_pairs():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, 4)))
    feature, value = rng.choice(quality.WIDTH, 12, replace=False), rng.random(12)
    want = 0.3 + model.w[feature] @ value
    for i, j in itertools.combinations(range(12), 2):
        want += model.v[feature[i]] @ model.v[feature[j]] * value[i] * value[j]
    assert abs(quality.raw_scores(model, np.array([0, 12]), feature, value)[0] - want) < 1e-9


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for _, p, y in held]) > 0.95
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert rows == quality.quality_scores(docs, labels).collect()


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x " * 200_000, None), (4, "\n \t", "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, text int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 5 and all(0 < r.score < 1 for r in got)
    assert quality.quality_scores(docs.limit(0), labels.limit(0)).collect() == []
    model = quality.train(docs, labels, quality.fold() != 1)
    assert quality.keep_good(docs, model, threshold=0.0).columns == docs.columns


def test_metadata_is_learnt_from(spark):
    rows = [(i, "the same words", 5 if i % 2 else None if i % 4 else 900_000) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality.train(docs, labels, quality.fold() != 1)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 2 == 1) for i in scores) and len({round(s, 9) for s in scores.values()}) == 3
    assert sorted(r.doc_id for r in quality.keep_good(docs, model).collect()) == [i for i in range(120) if i % 2]

"""Columns of the caller with any name, maps too, go through the operators that return rows."""

import pytest

pytest.importorskip("tallyforge.llm")

from tallyforge.llm import exact_dedup, mixing, ngram_join, secrets

NAMES = ["_key", "_copy", "_times", "_id", "_sha", "_s", "_w", "_seq", "_n", "parts", "_assign", "_all", "_scoped", "_linked", "key", "id", "row", "times", "given_0", "size", "n.dots"]


@pytest.fixture
def rows(spark):
    long = " ".join(f"word{k}" for k in range(60))
    texts = ["same text", "same text", f"{long} end", f"{long} END other", None, "token=abcdefghijklmnop here"]
    data = [(i, t, "en", f"s{i % 2}", i, *[f"{n}-{i}" for n in NAMES], {"a": i}) for i, t in enumerate(texts)]
    extra = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}, m map<string, int>")


def check(df, out, ids=None):
    assert out.columns[: len(df.columns)] == df.columns
    got = out.collect()
    for r in got:
        assert [r[n] for n in NAMES] == [f"{n}-{r.doc_id}" for n in NAMES] and r.m == {"a": r.doc_id}
    if ids is not None:
        assert sorted(r.doc_id for r in got) == ids
    return got


def test_exact_dedup(rows):
    check(rows, exact_dedup.dedup(rows, keep="largest"), [1, 2, 3, 4, 5])


def test_keep_one(rows):
    got = {r.doc_id for r in check(rows, ngram_join.keep_one(rows))}
    assert 2 in got and 3 not in got and 4 in got
    nameless = rows.withColumn("doc_id", rows.doc_id * 0 + None).drop("m")
    assert ngram_join.keep_one(nameless).columns == nameless.columns


def test_mixed_documents(rows):
    times = {r.id: r.times for r in mixing.mix(rows).collect()}
    got = [r.doc_id for r in check(rows, mixing.mixed_documents(rows))]
    assert {i: got.count(i) for i in times} == times


def test_scan_secrets(rows):
    out = secrets.scan_secrets(rows)
    assert out.columns == [*rows.columns, "parts_1"]
    assert [len(r.parts_1) for r in sorted(check(rows, out), key=lambda r: r.doc_id)] == [0, 0, 0, 0, 0, 1]

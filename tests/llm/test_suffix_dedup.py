"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pytest

np = pytest.importorskip("numpy")
suffix = pytest.importorskip("tallyforge.llm.suffix_dedup")
SCHEMA = "doc_id long, text string, k1 long, size int, runs string"


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("symbols", [1, 2, 4, 200])
def test_suffix_order(symbols):
    rng = np.random.default_rng(symbols)
    for n in [*range(1, 40), 300, 1001, 1002, 1003]:
        s = rng.integers(1, symbols + 1, n)
        want = sorted(range(n), key=lambda i: s[i:].tolist())
        assert suffix.suffix_order(s).tolist() == want


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(80), prose(150)
    out = ["", None, "x" * 199, "x" * 200, "y" * 201, "z" * 5000, "ab" * 300, "Oneded " * 800, prose(30) + "q" * 400 + prose(30)]
    for _ in range(40):
        out.append(prose(rng.randrange(20, 120)) + rng.choice([passage, other, passage[30:], "", other[:250]]) + prose(rng.randrange(20, 120)))
    base = prose(400)
    for _ in range(25):
        w = base.split(" ")
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out + [base] * 30 + ["x" * 200] + [prose(100)] * 2 + [passage[:100], "é" * 100, "é" * 100]


@pytest.mark.parametrize("hot", [False, True])
def test_equals_all_windows(spark, monkeypatch, hot):
    rows = list(texts())
    if hot:
        monkeypatch.setattr(suffix, "GROUP_BYTES", 2000)
        rows = rows[:60]
    df = spark.createDataFrame([(i, t, 1, 2, "") for i, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.repeat_digests(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        assert got[i] == w, (i, rows[i][:60] if rows[i] else rows[i])


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in suffix.repeat_digests(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())
    assert got == [(r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows]))]


def test_empty(spark):
    assert suffix.repeat_digests(spark.createDataFrame([], SCHEMA)).count() == 0

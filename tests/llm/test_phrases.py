"""Phrases against counters over all n-grams."""

import random
import re
from collections import Counter, defaultdict

import pytest

phrases = pytest.importorskip("tallyforge.llm.phrases")
SCHEMA = "doc_id long, text string, lang string, phrase string, n long, gram string, piece string, bucket int"


def brute(rows, top=2000, least=10, share=50, longest=3):
    f = defaultdict(Counter)
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cands = {g: v for g, v in c.items() if len(g) > 1 and v >= least}
        inside = Counter()
        for g, v in cands.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i : i + m]] = max(inside[g[i : i + m]], v)
        rank = []
        for g, a in cands.items():
            if 100 * inside[g] >= share * a and inside[g]:
                continue
            score, k = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rank.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, t, g, "p", 1, "g", "x", 2) for i, (t, g) in enumerate(rows)], SCHEMA)
    got = sorted(tuple(r) for r in phrases.top_phrases(df, **how).collect())
    assert got == brute(rows, **{{"min_count": "least", "max_words": "longest"}.get(k, k): v for k, v in how.items()})
    return got


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "Été", "a", "b", "x|y", "'s", " ", "\x1c", "w\x00"]
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " ! ", ";;", "\x0b"])
    return [("".join(rng.choice(words[: rng.choice([3, 6, 13])]) + gap() for _ in range(rng.randrange(0, 60))), rng.choice(["en", "fr", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_counters(spark, seed):
    rows = texts(seed) + [(None, "en"), ("", None), (" \t.,", "fr"), ("one two three " * 3000, "en")] + [("same piece here. same piece here", "en")] * 30
    assert check(spark, rows)
    check(spark, rows, top=3, min_count=2)


def test_longer_phrases_and_ties(spark):
    rows = texts(5, 60) + [("p q r s t u", "en")] * 12 + [("e f", "en"), ("g h", "en")] * 15
    check(spark, rows, max_words=5, min_count=5, share=80)


def test_nothing_to_find(spark):
    assert check(spark, []) == [] and check(spark, [(None, None), ("", "en"), ("a b c", "en")]) == []


def test_chunks_and_spill(spark, monkeypatch):
    """Many chunks a task give the same sums; workers import the module anew, so the function is called here."""
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 1 << 12)
    monkeypatch.setattr(phrases, "MEMORY", "20MB")
    rng = random.Random(3)
    pieces = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array(pieces[k : k + 50]), pa.array([2] * 50)], names=["lang", "piece", "n"]) for k in range(0, 4000, 50)]
    lists = list(phrases.dealt(2, 5)(iter(batches)))
    assert len(lists) > 5
    total = Counter()
    for bucket in range(5):
        own = [b.filter(pa.compute.equal(b["bucket"], bucket)) for b in lists]
        for out in phrases.totals(1)(iter(own)):
            for r in out.to_pylist():
                assert r["gram"] not in total
                total[r["gram"]] = r["n"]
    want = Counter()
    for p in pieces:
        w = p.split(" ")
        want.update({" ".join(w[i : i + 2]): 0 for i in range(len(w) - 1)})
        for i in range(len(w) - 1):
            want[" ".join(w[i : i + 2])] += 2
    assert total == want


def test_products_beyond_64_bits():
    pa = pytest.importorskip("pyarrow")
    big = 4_000_000_000_000
    row = {"lang": "en", "phrase": "x y z", "a": big, "parts": [{"cut": 1, "side": 0, "f": big + 7}, {"cut": 1, "side": 1, "f": big + 9}, {"cut": 2, "side": 0, "f": big + 9}, {"cut": 2, "side": 1, "f": big + 7}]}
    out = next(phrases.scored(iter([pa.RecordBatch.from_pylist([row])]))).to_pylist()[0]
    assert (out["l"], out["r"], out["score"]) == (big + 7, big + 9, 10**6 * big * big // ((big + 7) * (big + 9)))

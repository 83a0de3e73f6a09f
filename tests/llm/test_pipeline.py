"""Each stage of the pipeline against brute force on its own input."""

import base64
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tallyforge.llm")
P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

import corpus_pipeline
from tallyforge.llm import quality
from tallyforge.llm._common import cut

from .test_ngram_join import brute as near_brute
from .test_native import fill

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    inputs, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [tuple(r) for r in docs.collect()]
        docs = cut(stage(spark, docs, SF), f"test-{name}")
        if name != "encode":
            assert docs.columns == columns
    inputs["out"] = [(r.doc_id, r.ids) for r in docs.collect()]

    start = spark.read.parquet(f"{SF}/documents.parquet")
    scores = quality.score(start, quality.train(start, labels, quality.fold() != 1)).collect()
    assert sorted(r[0] for r in inputs["exact_dedup"]) == sorted(r.doc_id for r in scores if r.score >= 0.5)
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    left = {r[0] for r in inputs["exact_dedup"]}
    assert len(bad & left) <= 0.1 * len(bad) and len(good & left) >= 0.97 * len(good)

    last = {}
    for r in inputs["exact_dedup"]:
        key = lower(r[1])
        last[key] = max(last.get(key, r), r)
    assert sorted(inputs["near_dedup"]) == sorted(last.values())

    groups = {g for _, g, *_ in near_brute([(r[0], r[1]) for r in inputs["near_dedup"]])}
    assert sorted(inputs["mixing"]) == sorted(r for r in inputs["near_dedup"] if r[0] in groups)

    size = {r[0]: len((r[1] or "").split()) for r in inputs["mixing"]}
    sizes, taken, source = defaultdict(int), defaultdict(int), {r[0]: r[3] for r in inputs["mixing"]}
    for i, n in size.items():
        sizes[source[i]] += n
    times = Counter(r[0] for r in inputs["encode"])
    assert set(inputs["encode"]) <= set(inputs["mixing"]) and max(times.values()) <= 3
    for i, k in times.items():
        taken[source[i]] += k * size[i]
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 3)
    assert all(abs(taken[s] - want[s]) <= 0.15 * want[s] for s in sizes)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted(inputs["out"]) == sorted((r[0], enc.encode_ordinary(r[1] or "")) for r in inputs["encode"])


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "starts"] and out.count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5

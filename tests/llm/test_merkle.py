"""Merkle manifests against trees built in lists."""

import hashlib
import random
import zlib

import pytest

merkle = pytest.importorskip("tallyforge.llm.merkle")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree long, place int, other string, root string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    i, text, lang, source, n = row
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def climb(nodes):
    """Root, and for each node its siblings by level and the places to fold."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a // 16 * 16 : a // 16 * 16 + 16]
            paths[k].append((a % 16, run))
        level = [H("".join(level[a : a + 16])) for a in range(0, len(level), 16)]
        at = [a // 16 for a in at]
    return level[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *climb([leaf(r) for r in own]))
    root, tops = climb([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            now = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                now = leaf((r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:]))
            siblings = []
            for slot, run in path + top:
                siblings += run[:slot] + run[slot + 1 :]
                now = H("".join([*run[:slot], now, *run[slot + 1 :]]))
            out.append((r[0], leaf(r), subroot, root, H("".join(siblings)), now, now == root))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "l", 1, 2, "o", "r") for r in rows], SCHEMA)
    got = [tuple(r) for r in merkle.proof_digests(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, None: 1}, {"a": 17, "b": 1, "é": 2}, {**{f"s{k}": k % 4 + 1 for k in range(40)}, "z": 300}])
def test_against_lists(spark, sizes):
    rng = random.Random(len(sizes))
    ids = iter(rng.sample(range(10_000), sum(sizes.values())))
    rows = [(next(ids), rng.choice(["Text", "text", None, "", "Été" * 100]), rng.choice(["en", None]), s, rng.choice([None, 5, -3])) for s, n in sizes.items() for _ in range(n)]
    got = check(spark, rows)
    assert any(r[6] for r in got)


def test_repeated_rows_nulls_and_long_texts(spark):
    rows = [(None, "A", None, None, None)] * 3 + [(5, "A", "en", "s", 1)] * 20 + [(5, "B", "en", "s", 1), (6, "X" * 300_000, "en", "", 2), (7, None, None, "s", None)]
    check(spark, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(df).root is None and merkle.proof_digests(df).count() == 0


def test_any_change_shows(spark):
    """Proofs list the siblings; a manifest of changed rows has another root."""
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    whole = merkle.manifest(df)
    proof = merkle.proofs(whole, siblings=True).where("id = 7").first()
    assert proof.verified and H("".join(proof.siblings)) == proof.proof_sha256 and len(proof.siblings) == 15 + 1 + 2
    assert merkle.manifest(df.where("doc_id <> 7")).root != whole.root
    assert merkle.manifest(df.repartition(7)).root == whole.root

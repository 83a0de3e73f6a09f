"""The near-duplicate join against all pairs in plain Python."""

import itertools
import random

import pytest

join = pytest.importorskip("tallyforge.llm.ngram_join")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, seq string, node int, cluster int"


def grams(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """{position: (group, copies, links)} by the definitions."""
    words = [tuple((t or "").split()) for _, t in rows]
    classes = {}
    for i, w in enumerate(words):
        classes.setdefault(w, []).append(i)
    reps = {w: min(rows[i][0] for i in at) for w, at in classes.items()}
    sets = {w: grams(" ".join(w)) for w in classes}
    near = {w: set() for w in classes}
    for a, b in itertools.combinations(classes, 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            near[a].add(b)
            near[b].add(a)
    root = {}
    for w in sorted(classes, key=reps.get):
        todo = [w]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = reps[w]
                todo += near[x]
    return sorted((rows[i][0], root[w], reps[w], len(classes[w]), len(near[w])) for i, w in enumerate(words))


def mutated(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts += [mutated(rng, base, k % 6) for k in range(150)]  # one large group
    texts += [" ".join(base) + f" tail{k} more of it and on" for k in range(20)]
    texts += ["", None, " \n", "one two", "one  two", "two one", "a b c d e", "a b c d e f", "x" * 50_000, "hot copy of a text here"] + ["hot copy of a text here"] * 60
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    want = brute(rows)
    assert sorted(map(tuple, join.near_groups(df).collect())) == want
    monkeypatch.setattr(join, "BLOCK_ROWS", 32)  # the large group in many blocks
    assert sorted(map(tuple, join.near_groups(df).collect())) == want
    kept = join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[1] for w in want})


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", "", 0, 0), (None, "a b c d e f", "", 0, 0), (5, "q r s", None, None, None), (5, "q r s", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = join.near_groups(df).collect()
    assert sorted((r.id or 0, r.n_copies, r.n_links) for r in got) == [(0, 2, 0), (0, 2, 0), (5, 2, 0), (5, 2, 0)]
    assert sorted((r.doc_id or 0, r.text) for r in join.keep_one(df).collect()) == [(0, "a b c d e f"), (5, "q r s")]
    assert join.near_groups(df.limit(0)).count() == 0


def test_the_forest_stops_at_the_recall(spark, monkeypatch):
    d = join.floor_depth()
    miss = [(1 - 0.8**k) ** join.TREES for k in (d, d + 1)]
    assert miss[0] <= 1 - join.RECALL < miss[1]
    rng, depths, own = random.Random(8), [], join._buckets
    monkeypatch.setattr(join, "_buckets", lambda forest, rows, depth, before: depths.append(depth) or own(forest, rows, depth, before))
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    close = [(i, " ".join([*base, f"tail{i}"]), "", 0, 0) for i in range(120)]  # links of 0.99 say that whole labels are enough
    got = join.near_groups(spark.createDataFrame(close, SCHEMA)).collect()
    assert depths == [join.DEPTH] and all(r.n_links == 119 for r in got)
    depths.clear()
    far = [(2 * i + k, " ".join([f"t{i}w{j}" for j in range(40)] + [f"x{k}{i}{j}" for j in range(5)]), "", 0, 0) for i in range(300) for k in (0, 1)]
    pairs = join.near_groups(spark.createDataFrame(far, SCHEMA)).collect()  # 36 of 46 shingles: below
    assert all(r.n_links == 0 for r in pairs) and depths[-1] == join.floor_depth()
    depths.clear()
    near = [(2 * i + k, " ".join([f"t{i}w{j}" for j in range(40)] + [f"x{k}{i}{j}" for j in range(4)]), "", 0, 0) for i in range(300) for k in (0, 1)]
    pairs = join.near_groups(spark.createDataFrame(near, SCHEMA)).collect()  # 36 of 44: above, and not all at the first depth
    assert all(r.n_links == 1 for r in pairs) and len(depths) > 1


def test_ids_of_any_type(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [("x", a), ("b", a + " end"), (None, b), (None, b + " end"), ("c", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(map(tuple, join.near_groups(df).collect()), key=str)
    assert [g[1] for g in got if g[0] in ("x", "b")] == ["b", "b"] and [g[4] for g in got] == [1, 0, 1, 1, 1]
    kept = sorted((r.doc_id or "") for r in join.keep_one(df).collect())
    assert kept == ["", "b", "c"]


def test_ids_do_not_stand_for_rows(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    texts = [(1, a), (1, b), (2, b + " end"), (None, a + " end"), (None, c), (None, c + " end"), (1, d + " end"), (0, d), (7, ""), (None, " ")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in texts], SCHEMA)
    got = [(r.id, r.group_id, r.copy_of, r.n_copies, r.n_links) for r in join.near_groups(df).collect()]
    assert sorted(r[4] for r in got) == [0, 0] + [1] * 8
    nulls = sorted(r[1] for r in got if r[0] is None)
    assert nulls[0] == nulls[1] < 0 and nulls[2:] == [1, 7]
    assert [r[1] for r in got if r[0] == 2] == [1] and [r[1] for r in got if r[0] == 0] == [0]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in join.keep_one(df).collect())
    assert [k[:2] for k in kept] == [(False, 0), (False, 1), (False, 1), (False, 7), (True, 0)]
    assert [k[2] for k in kept[:4]] == [d, a, b, ""] and kept[4][2] in (c, c + " end")

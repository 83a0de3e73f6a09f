"""Line dedup against a dictionary of first documents."""

import hashlib
import random

import pytest

lines = pytest.importorskip("tallyforge.llm.line_dedup")
SCHEMA = "doc_id long, text string, h long, keep long, doc string, batch int, hashes string, gone int"
SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    """(id, text) rows: (id, lines, dropped, kept text)."""
    order = lambda i: (i is None, i or 0)
    first, holders = {}, {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key_of(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, order(i)), order(i))
                holders.setdefault(k, set()).add(i)
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(holders.get(key_of(x), ())) < 2 or first[key_of(x)] == order(i)]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "d", 3, "x", 4) for i, t in rows], SCHEMA)


def got(df, **how):
    return sorted(((r.id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(df, **how).collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_against_brute_force(spark, batches):
    rng = random.Random(batches)
    pool = ["The same line again", "the SAME line again", "\t the same line again \r", "été passé à Nîmes", "ÉTÉ passé à nîmes", "short", "", "  ", "0123456789", "012345678", " next line\x0b", "x" * 50]
    rows = []
    for i in rng.sample(range(-50, 500), 150):
        rows.append((i, "\n".join(rng.choice([*pool, f"own line of {i} {rng.randrange(5)}"]) for _ in range(rng.randrange(0, 25)))))
    rows += [(7000, None), (7001, ""), (7002, "\n\n"), (None, "The same line again\nnull id line one\nnull id line one"), (None, "null id line one"), (7003, "null id line one")]
    rows += [rows[0], rows[0], (rows[1][0], "another text of an id\nown text, repeated id"), (rows[1][0], "own text, repeated id")]
    assert got(frame(spark, rows), batches=batches) == sorted(brute(rows), key=repr)


def test_empty_table_and_hot_line(spark):
    assert got(frame(spark, []).limit(0)) == []
    rows = [(i, f"a line that all documents have\nline number {i} here") for i in range(400)]
    rows.append((1000, "\n".join(f"very long text line {k}" for k in range(20_000)) + "\na line that all documents have"))
    rows.append((1001, "\n".join(f"very long text line {k}" for k in range(20_000))))
    assert got(frame(spark, rows)) == sorted(brute(rows), key=repr)


def test_string_identifiers(spark):
    rows = [(f"d{i:03d}", f"shared line of texts\nown {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sum(r[2] for r in got(df)) == 39 and [r for r in got(df) if r[0] == "d000"][0][2] == 0


def test_runs_meet_in_levels_and_stay_sorted(spark):
    """Batches by hand: runs are merged two by two, no run is shuffled or sorted for a join."""
    index = lines.LineRuns(spark, 3)
    doc = lambda ids, hs: spark.createDataFrame([(i, bytes([h]) * 16) for i in ids for h in hs], "doc long, h binary")
    assert index.add(doc([1, 2], [1, 2]))[1] == 4
    assert [len(x) for x in index.levels] == [1]
    lost, _ = index.add(doc([3], [2, 3]))
    assert [(r.h[0], r.keep) for r in lost.collect()] == [(2, 1)]
    assert [len(x) for x in index.levels] == [0, 1]
    index.add(doc([4], [4]))
    lost, _ = index.add(doc([5, 6], [1, 4, 5]))
    assert sorted((r.h[0], r.keep) for r in lost.collect()) == [(1, 1), (4, 4), (5, 5)]
    assert [len(x) for x in index.levels] == [0, 0, 1]
    assert sorted((r.h[0], r.keep) for r in index.runs()[0].collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    with lines.sorted_reads(spark):
        a, b = index.runs()[0].hint("merge"), index.runs()[0].withColumnRenamed("keep", "k2")
        plan = a.join(b, "h")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    index.drop()


def test_native(spark):
    """No Python in the plan."""
    df = frame(spark, [(1, "some text line here"), (2, "some text line here")])
    plan = lines.line_digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    digest = {r.doc_id: r.kept_sha256 for r in lines.line_digests(df).collect()}
    assert digest == {1: hashlib.sha256(b"some text line here").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}

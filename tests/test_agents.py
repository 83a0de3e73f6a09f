"""Readers of agents' logs on small logs made here."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import lenient_json as J
from tallyforge.sources import agents, sinks
from tallyforge.sources import patches as patch_logs
from tallyforge.sources import files as raw

PAD = "x" * 80


def line(**over):
    usage = over.pop("usage", {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 6})
    message = {"id": "m1", "model": "claude-opus-5-20260101", "usage": usage} | over.pop("message", {})
    row = {"type": "assistant", "sessionId": "s", "requestId": "r", "cwd": "/c", "gitBranch": "b", "timestamp": "2026-01-02T03:04:05.006Z", "message": message, "pad": PAD}
    return json.dumps(row | over, separators=(",", ":"))


def read(spark, rows, columns="line string, ord long"):
    return spark.createDataFrame([(r, i) if isinstance(r, str) else r for i, r in enumerate(rows)], columns)


def test_transcripts(spark):
    split = lambda total, m5, h1: {"cache_creation_input_tokens": total, "cache_creation": {"ephemeral_5m_input_tokens": m5, "ephemeral_1h_input_tokens": h1}}
    rows = [
        line(), line(requestId=""), line(usage=split(9, 4, 5)), line(usage=split(9, 1, 5)), line(usage=split(3, 1, 5)), line(usage=split(9, 0, 0)),
        line(usage={"input_tokens": "7", "output_tokens": True, "cache_read_input_tokens": 2.9}), line(message={"model": "<synthetic>"}), line(message={"model": ""}),
        line(timestamp="soon"), line(type="user"), line()[:-3], line().replace('"type":"assistant"', '"type": "assistant"'), "{}", line(message={"usage": [1]}), line(cwd=5),
    ]
    got = {r.ord: r for r in agents.transcript_records(read(spark, rows)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6, 15]
    assert tuple(got[0])[:12] == (1767323045006, "claude-opus-5", 3, 6, 0, 5, 4, 0, "s", "r", "/c", "b")
    assert got[1].request == "m1" and got[15].cwd == ""
    assert [(got[i].cw5m, got[i].cw1h) for i in (2, 3, 4, 5)] == [(4, 5), (4, 5), (0, 5), (9, 0)]
    assert (got[6].input, got[6].output, got[6].cr) == (0, 0, 2)


def test_numbered_lines(spark, tmp_path):
    (tmp_path / ".hid").mkdir()
    (tmp_path / "b.jsonl").write_text("1\r\n2")
    (tmp_path / ".hid/a.jsonl").write_text("3\n")
    (tmp_path / "c.txt").write_text("no")
    rows = raw.numbered_lines(raw.source_tree(spark, {"p": str(tmp_path)}), r"\.jsonl$").orderBy("ord").collect()
    assert [r.line for r in rows] == ["3", "", "1", "2"]


def test_codex(spark):
    token = lambda total, at="2026-01-01T00:00:01Z", **last: json.dumps(
        {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": total}, "last_token_usage": last}}}
    )
    rows = [
        json.dumps({"type": "session_meta", "payload": {"id": "S", "cwd": "/meta"}}), token(10, input_tokens=8, cached_input_tokens=3, output_tokens=2),
        json.dumps({"type": "turn_context", "payload": {"model": "gpt-5.5", "cwd": "/turn"}}), token(10, input_tokens=9), token(20, "bad", input_tokens=1),
        token(20, input_tokens=4), token(30, input_tokens=1, cached_input_tokens=5, reasoning_output_tokens=6), json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": None}}),
        "token_count broken {",
    ]
    df = spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "path string, ord long, line string")
    got = agents.codex_records(df).orderBy("ord").collect()
    assert [(r.ord, r.model, r.input, r.cr, r.output, r.thinking, r.session, r.cwd, r.request, r.cost) for r in got] == [
        (1, "unknown", 5.0, 3.0, 2.0, 0.0, "S", "/meta", "codex:2026-01-01T00:00:01Z:10", None),
        (6, "gpt-5.5", 0.0, 5.0, 0.0, 6.0, "S", "/turn", "codex:2026-01-01T00:00:01Z:30", None),
    ]


def test_cline(spark):
    metrics = {"inputTokens": 10, "outputTokens": 2, "cacheReadTokens": 3, "cacheWriteTokens": 1}
    body = {"messages": [
        {"id": "a", "role": "assistant", "ts": 5, "modelInfo": {"id": "m"}, "metrics": metrics | {"cost": 0}}, {"role": "user", "metrics": metrics},
        {"role": "assistant", "ts": 0, "metrics": metrics | {"cost": "1"}}, {"id": "z", "role": "assistant", "metrics": {"inputTokens": 0}}, {"role": "assistant"},
    ]}
    head = {"model": "hm", "started_at": "1970-01-01T00:00:09Z", "cwd": "/w"}
    text = "dir string, ord long, content string"
    got = agents.cline_records(spark.createDataFrame([("d", 0, json.dumps(body)), ("e", 100, "{")], text), spark.createDataFrame([("d", 0, json.dumps(head))], text))
    rows = got.orderBy("ord").collect()
    assert [(r.ts, r.model, r.input, r.cw, r.cr, r.output, r.cost, r.session, r.request, r.cwd) for r in rows] == [
        (5, "m", 6.0, 1.0, 3.0, 2.0, 0.0, "d", "cline:a", "/w"), (9000, "hm", 6.0, 1.0, 3.0, 2.0, None, "d", "cline:0", "/w"),
    ]


def test_lmstudio(spark):
    step = lambda n, i=None, m=None: {"stepIdentifier": i, "genInfo": {"identifier": m, "stats": {"promptTokensCount": n, "predictedTokensCount": 1}}}
    talk = {"createdAt": 7, "lastUsedModel": {"identifier": "last"}, "messages": [
        {"currentlySelected": 1, "versions": [{"role": "assistant", "steps": [step(9)]}, {"role": "assistant", "steps": [step(1, "1700-1", "m"), {"genInfo": {}}, step(2)]}]},
        {"currentlySelected": 5, "versions": [{"role": "assistant", "steps": [step(3, "x-1")]}]}, {"versions": [{"role": "user", "steps": [step(4)]}]}, {"currentlySelected": -1, "versions": []},
    ]}
    df = spark.createDataFrame([("t.conversation.json", 0, json.dumps(talk))], "name string, ord long, content string")
    rows = agents.lmstudio_records(df).orderBy("ord").collect()
    assert [(r.ts, r.model, r.input, r.cost, r.session, r.request) for r in rows] == [
        (1700, "m", 1.0, 0.0, "t", "lmstudio:1700-1"), (7, "last", 2.0, 0.0, "t", "lmstudio:7"), (7, "last", 3.0, 0.0, "t", "lmstudio:x-1"),
    ]


def database(path, **tables):
    with sqlite3.connect(path) as db:
        for name, (columns, rows) in tables.items():
            db.execute(f"create table {name} ({columns})")
            db.executemany(f"insert into {name} values ({','.join('?' * len(rows[0]))})", rows)
    return str(path)


def test_sqlite_agents(spark, tmp_path):
    z = database(
        tmp_path / "z.db", session=("id, directory", [("s", "/d")]),
        model_usage=("id, session_id, model_id, started_at, input_tokens, output_tokens, reasoning_tokens, cache_creation_input_tokens, cache_read_input_tokens",
                     [("1", "s", "m", 5, 10, 1, 2, 3, 4), ("2", "gone", "m", 5, 0, 1, 0, 0, 9), ("3", "s", "m", 5, 0, 0, 0, 0, 0)]),
    )
    numbers = ", ".join(f"{c} double" for c in "started_at input_tokens output_tokens reasoning_tokens cache_creation_input_tokens cache_read_input_tokens".split())
    use = raw.sqlite_table(spark, [z, str(tmp_path / "none.db")], "model_usage", f"id string, session_id string, model_id string, {numbers}")
    rows = agents.zcode_records(use, raw.sqlite_table(spark, [z], "session", "id string, directory string")).orderBy("ord").collect()
    assert [(r.input, r.cw, r.cr, r.cwd, r.request) for r in rows] == [(3.0, 3.0, 4.0, "/d", "1"), (0.0, 0.0, 9.0, "", "2")]
    assert raw.sqlite_table(spark, [z], "no_table", "id string").count() == 0

    data = lambda **x: json.dumps({"role": "assistant", "modelID": "m", "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 5}}} | x)
    zero = {"tokens": {"input": 0, "output": 0}}
    o = database(
        tmp_path / "o.db", session=("id, directory", [("s", "/d")]),
        message=("id, session_id, time_created, data", [("1", "s", 9, data(cost=0)), ("2", "s", 9, data(cost=0, modelID="m:FREE", time={"created": 7}, path={"cwd": "/p"})), ("3", "s", 9, data(cost=2)),
                                                        ("4", "s", 9, data(role="user")), ("5", "s", 9, data(**zero)), ("6", "s", 9, data(cost=1, **zero)), ("7", "s", 9, "{")]),
    )
    m = raw.sqlite_table(spark, [o], "message", "id string, session_id string, time_created double, data string")
    rows = agents.opencode_records(m, raw.sqlite_table(spark, [o], "session", "id string, directory string"), "kilo").orderBy("ord").collect()
    assert [(r.ts, r.output, r.thinking, r.cost, r.cwd, r.request) for r in rows] == [(9, 5.0, 3.0, None, "/d", "1"), (7, 5.0, 3.0, 0.0, "/p", "2"), (9, 5.0, 3.0, 2.0, "/d", "3"), (9, 0.0, 0.0, 1.0, "/d", "6")]

    columns = "id, model, started_at, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, actual_cost_usd, estimated_cost_usd, cwd, api_call_count"
    h = database(tmp_path / "h.db", sessions=(columns, [("a", "m", 1.0005, 1, 0, 0, 0, 0, 0, 5, "/c", 3), ("b", "m", 2, 1, 0, 0, 0, 0, None, 0, None, 0), ("c", "m", 2, 1, 0, 0, 0, 0, None, 0.5, "", None), ("d", "m", 2, 0, 0, 9, 0, 0, 1, 1, "", 1)]))
    kinds = {"id": "string", "model": "string", "cwd": "string"}
    s = raw.sqlite_table(spark, [h], "sessions", ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns.split(", ")))
    assert [(r.ts, r.cost, r.calls, r.request) for r in agents.hermes_records(s).orderBy("ord").collect()] == [(1001, 0.0, 3, "hermes:a"), (2000, None, 1, "hermes:b"), (2000, 0.5, 1, "hermes:c")]


def test_copilot(spark):
    patches = [
        {"kind": 0, "v": {"sessionId": "S", "creationDate": 50, "inputState": {"selectedModel": {"identifier": "copilot/pick"}}, "requests": []}},
        {"kind": 2, "k": ["requests"], "v": [{"requestId": "r0", "timestamp": 5, "modelId": "copilot/gpt", "promptTokens": 7}, {"promptTokens": 1}, 3]},
        {"kind": 1, "k": ["requests", 0, "completionTokens"], "v": 9}, {"kind": 1, "k": ["requests", 0, "completionTokens"], "v": 4}, {"kind": 1, "k": ["requests", 0, "response"], "v": "long"},
        {"kind": 1, "k": ["requests", 1, "result", "metadata"], "v": {"outputTokens": 2, "toolCallRounds": [1, 2, 3]}}, {"kind": 2, "k": ["requests"], "i": 2, "v": {"promptTokens": 0}},
        {"kind": 1, "k": ["requests", 4, "promptTokens"], "v": 6},
    ]
    text = "\n".join([*map(json.dumps, patches), "{broken", ""])
    files = spark.createDataFrame([("d", "f.jsonl", 0, text), ("e", "g.jsonl", 100, "{}")], "dir string, name string, ord long, content string")
    w = spark.createDataFrame([("d", json.dumps({"folder": "file:///d%3A/my%20w"}))], "dir string, content string")
    rows = agents.copilot_records(files, w).orderBy("ord").collect()
    assert [(r.ts, r.model, r.input, r.output, r.request, r.calls, r.cwd) for r in rows] == [
        (5, "gpt", 7.0, 9.0, "r0", 1, "d:\\my w"), (50, "pick", 1.0, 2.0, "S:1", 3, "d:\\my w"), (50, "pick", 6.0, 0.0, "S:4", 1, "d:\\my w"),
    ]
    log = patch_logs.of_lines(['{"kind":2,"k":["a"],"v":[1,2,3]}', '{"kind":2,"k":["a"],"i":-1,"v":[9]}', '{"kind":1,"k":["b","2"],"v":1}', '{"kind":1,"k":["c",99999999],"v":1}'])
    assert log.document() == {"a": [1, 2, 9], "b": {"2": 1}, "c": []}


def random_patch(rng):
    path = [rng.choice(["a", "b", 0, 1, 2, "1", 3.0, 1.5, "requests", None, True])for _ in range(rng.randrange(1, 4))]
    value = rng.choice([1, "x", None, [1, 2], {"a": [3]}, [], [[5, 6], {"b": 1}], True])
    kind = rng.choice([0, 1, 1, 1, 2, 2, 2, 2, 3, "1", True])
    if rng.random() < 0.15:
        kind, path, value = 1, ["requests", rng.choice([0, 1, 2.0, "0", 0.5]), "completionTokens"], rng.choice([3, 9.5, "4", None])
    patch = {"kind": kind, "k": path, "v": value}
    if rng.random() < 0.4:
        patch["i"] = rng.choice([0, 1, 2, 5, -1, -2, -9, 1.5, -0.5, "1", True])
    if rng.random() < 0.1:
        del patch[rng.choice(["k", "v"])]
    return patch


def test_patches_compose(spark):
    """A log folded by blocks, in any grouping, is the log applied patch by patch."""
    rng = random.Random(8)
    logs = []
    for n in range(150):
        lines = [json.dumps(random_patch(rng)) for _ in range(rng.randrange(0, 30))]
        lines += ["{", "[]", ""][: n % 4]
        logs.append(lines)
        document, seen = {}, {}
        for line in lines:
            one = patch_logs.of_lines([line])
            if one.change is not None:
                document = one.change(document)
            for k, v in one.completion.items():
                seen[k] = max(seen.get(k, 0), v)
        document = json.loads(json.dumps(document))
        for size in (1, 3, 100):
            parts = [patch_logs.packed(patch_logs.of_lines(lines[k : k + size])) for k in range(0, len(lines), size)]
            left = patch_logs.Log()
            for part in parts:
                left.and_then(patch_logs.unpacked(part))
            while len(parts) > 1:  # the other way round
                last = patch_logs.unpacked(parts.pop())
                parts[-1] = patch_logs.packed(patch_logs.unpacked(parts[-1]).and_then(last))
            right = patch_logs.unpacked(parts[0]) if parts else patch_logs.Log()
            assert left.document() == right.document() == document and left.completion == right.completion == seen
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(logs)], "id int, content string")
    whole = {r.id: (r.state, r.completion) for r in patch_logs.documents(df, ["id"]).collect()}
    assert len(whole) == 150 and whole == {r.id: (r.state, r.completion) for r in patch_logs.documents(df, ["id"], block=2).collect()}


def test_what_patches_do():
    doc = lambda *ps: patch_logs.of_lines(map(json.dumps, ps)).document()
    put = lambda *k, v=1: {"kind": 1, "k": list(k), "v": v}
    cut = lambda *k, v=1, **i: {"kind": 2, "k": list(k), "v": v} | i
    assert doc(put("a", 2, "b")) == {"a": [None, None, {"b": 1}]}
    assert doc(put("a", "2")) == {"a": {"2": 1}} and doc(put("a", 0, v=5), put("a", "1")) == {"a": [5, 1]}
    assert doc(put("a", 0), put("a", "x")) == {"a": [1]} and doc(put("a", 0), put("a", "x", "y"), cut("a", "z")) == {"a": [1]}
    assert doc(cut("a", v=[1, 2, 3]), cut("a", v=[8, 9], i=1)) == {"a": [1, 8, 9]} == doc(cut("a", v=[1, 2, 3]), cut("a", v=[8, 9], i=-2))
    assert doc(cut("a", v=[1, 2, 3]), cut("a", v=9, i=1.5)) == {"a": [1, 9, 3]} and doc(cut("a", v=7, i=4)) == {"a": [7]}
    assert doc(put("a", v="text"), cut("a", v=[1])) == {"a": [1]} and doc(put("a", v="text"), put("a", "b")) == {"a": {"b": 1}}
    assert doc({"kind": 0, "v": [1]}, put(1)) == [1, 1] and doc({"kind": 0, "v": 5}) == {} and doc(put("a", "response")) == {}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(n, value):
    if isinstance(value, int):
        return varint(n * 8) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(n * 8 + 2) + varint(len(value)) + value


def test_antigravity(spark, tmp_path):
    use = lambda model, **x: field(1, field(1, 100) + field(2, 7_000_000)) + field(9, field(1, model) + field(2, 300) + field(3, 4) + field(4, 5) + field(5, 6) + field(9, 2) + b"".join(field(11, v) for v in x.values()))
    gen = lambda model, name: field(1, field(4, field(1, model)) + field(19, name))
    a = database(tmp_path / "a.db", steps=("idx, metadata", [(0, use(1, r="q")), (1, use(2)), (2, None), (3, field(1, field(1, 1))), (4, b"\xff\xff")]), gen_metadata=("data", [(gen(1, "own"),)]),
                 trajectory_metadata_blob=("data", [(field(1, field(1, "file:///c%3A/w")),)]))
    b = database(tmp_path / "b.db", steps=("idx, metadata", [(7, use(1)), (8, use(3))]), gen_metadata=("data", [(gen(2, "two"),), (gen(1, "other"),)]))
    t = lambda name, columns: raw.sqlite_table(spark, [a, b], name, columns)
    rows = agents.antigravity_records(t("steps", "idx string, metadata binary"), t("gen_metadata", "data binary"), t("trajectory_metadata_blob", "data binary")).orderBy("session", "ord").collect()
    assert [(r.ts, r.model, r.input, r.output, r.cw, r.cr, r.thinking, r.request, r.cwd) for r in rows] == [
        (100007, "own", 300.0, 4.0, 5.0, 6.0, 2.0, "q", "c:\\w"), (100007, "two", 300.0, 4.0, 5.0, 6.0, 2.0, "a:1", "c:\\w"),
        (100007, "other", 300.0, 4.0, 5.0, 6.0, 2.0, "b:7", ""), (100007, "unnamed model #3", 300.0, 4.0, 5.0, 6.0, 2.0, "b:8", ""),
    ]
    assert agents.decode_message(field(1, 300) + b"\x12\x7f" + b"ab") == {1: [300.0], 2: [b"ab"]}


def test_lenient_json(spark):
    doc = '{"n":1.5,"s":"2","b":true,"z":0,"e":"","o":{},"a":[],"x":null,"neg":-2.7}'
    v = F.col("v")
    df = spark.createDataFrame([(doc,)], "t string").select(J.parse(F.col("t")).alias("v"))
    paths = ["n", "s", "b", "z", "e", "o", "a", "x", "missing"]
    r = df.select(*[J.num(v, f"$.{p}").alias(f"n_{p}") for p in paths], *[J.truthy(v, f"$.{p}").alias(f"t_{p}") for p in paths], *[J.text(v, f"$.{p}").alias(f"s_{p}") for p in paths], J.long(v, "$.neg").alias("neg")).first()
    assert [r[f"n_{p}"] for p in paths] == [1.5, 0, 0, 0, 0, 0, 0, 0, 0]
    assert [r[f"t_{p}"] for p in paths] == [True, True, True, False, False, True, True, False, False]
    assert [r[f"s_{p}"] for p in paths] == ["", "2", "", "", "", "", "", "", ""] and r.neg == -2


def test_project_import(spark, tmp_path):
    rows = [{"name": "", "rootPath": "d:\\a\\b\\"}, {"name": "n", "rootPath": "/x"}, {"name": "none", "rootPath": " "}]
    for text in (json.dumps(rows), json.dumps({"projects": rows})):
        assert [(r.name, r.root_path) for r in sinks.import_projects(spark, text).orderBy("ord").collect()] == [("b", "d:\\a\\b\\"), ("n", "/x")]
    sinks.export_projects(rows, str(tmp_path / "p.json"))
    assert sinks.read_document(str(tmp_path / "p.json"), {})["format"] == sinks.FORMAT
    (tmp_path / "bad.json").write_text("{")
    assert sinks.read_document(str(tmp_path / "bad.json"), {"d": 1}) == {"d": 1} and (tmp_path / "bad.json.corrupt").exists()
    assert sinks.read_document(str(tmp_path / "none.json"), {"d": 1}) == {"d": 1}


@pytest.mark.parametrize("text,want", [("a", True), ("<b>", True)])
def test_page_escapes(text, want):
    page = sinks.report_page(text, {"x": "</script>"}, [(text, "1")])
    assert ("</script>" in page.split('id="data">')[1].split("\n")[0].replace("</script>", "", 1)) != want


def test_sqlite_by_row_ranges(spark, tmp_path):
    """Many tasks of one table, holes and negative rowids, a view, a table without rowids, rows still in the log."""
    path = tmp_path / "t.db"
    db = sqlite3.connect(path)
    db.execute("pragma journal_mode = wal")
    db.execute("create table t (id integer primary key, x text, n real)")
    ids = [*range(-5, 3000), *range(10**9, 10**9 + 2000), 2**60]
    db.executemany("insert into t values (?, ?, ?)", [(i, f"x{i}", i / 2) for i in ids])
    db.execute("create table w (k text primary key, v) without rowid")
    db.executemany("insert into w values (?, ?)", [(f"k{i:03d}", i) for i in range(300)])
    db.execute("create view seen as select x, n from t where id < 10")
    db.execute('create table "odd ""name" (a)')
    db.execute('insert into "odd ""name" values (7)')
    db.commit()
    assert (tmp_path / "t.db-wal").stat().st_size
    read = lambda table, columns, rows=700: raw.sqlite_table(spark, [str(path)], table, columns, rows)
    df = read("t", "x string, n double, gone string")
    assert df.rdd.getNumPartitions() == -(-len(ids) // 700)
    assert [tuple(r)[1:] for r in df.orderBy("row").collect()] == [(i, f"x{i}", i / 2, None) for i in ids]
    db.execute("delete from t where id >= 0")
    db.commit()
    late = read("t", "x string")
    db.execute("begin exclusive")  # a writer holds it
    assert late.count() == 5 and read("t", "x string").count() == 5
    db.rollback()
    locked = sqlite3.connect(tmp_path / "l.db")
    locked.execute("create table t (x text)")
    locked.execute("insert into t values ('a')")
    locked.commit()
    locked.execute("begin exclusive")  # no log beside it: its file is copied
    assert raw.sqlite_table(spark, [str(tmp_path / "l.db")], "t", "x string").count() == 1
    locked.close()
    assert sorted(r.k for r in read("w", "k string, v double").collect()) == [f"k{i:03d}" for i in range(300)]
    assert read("seen", "x string").count() == 5 and read("none", "x string").count() == 0 and read('odd "name', "a string").first().a == "7"
    db.close()


def test_a_large_table_is_streamed(tmp_path):
    """A task holds a row at a time."""
    import tracemalloc

    with sqlite3.connect(tmp_path / "l.db") as db:
        db.execute("create table t (x)")
        db.executemany("insert into t values (?)", (("y" * 1000,) for _ in range(20_000)))
    tracemalloc.start()
    n = sum(1 for _ in raw.read_sqlite("l", str(tmp_path / "l.db"), "t", ["x"], 1, None))
    assert n == 20_000 and tracemalloc.get_traced_memory()[1] < 2 << 20
    tracemalloc.stop()


def test_steps_are_written_without_a_series_a_row(monkeypatch):
    import pandas as pd

    from tallyforge.plans import readers

    monkeypatch.setattr(pd.DataFrame, "apply", None)
    rows = pd.DataFrame({"ord": [1, 20], "ts": [1500, 2000], "number": 3, "input": [300, 1], "output": 2, "cw5m": 1, "cr": 0, "thinking": 127, "request": ["r", ""]})
    got = agents.step_usage(readers._steps(rows))
    assert got["ok"].tolist() == [True, False] and got.loc[0].tolist() == [True, 1500.0, 3.0, 300.0, 2.0, 1.0, 0.0, 127.0, "r"]

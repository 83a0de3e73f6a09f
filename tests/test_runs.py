"""The usage of a whole home folder, agents found, missing, empty and broken."""

import json
import os
import sqlite3

from tallyforge.operators import usage
from tallyforge.plans import runs
from tallyforge.sources import registry

from .test_agents import field, line


def test_usage_of_a_home(spark, tmp_path):
    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put(".claude/projects/p/s.jsonl", "\n".join([line(requestId="a"), line(requestId="a", usage={"input_tokens": 3, "output_tokens": 9}), line(requestId="b"), "{"]))
    put(".claude/projects/p/sub/agent.jsonl", line(requestId="", message={"id": ""}))
    put(".codex/sessions/2026/rollout-1.jsonl", json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "event_msg", "payload": {
        "type": "token_count", "info": {"total_token_usage": {"total_tokens": 5}, "last_token_usage": {"input_tokens": 5}}}}))
    put(".codex/sessions/other.jsonl", "token_count")
    put(".cline/data/sessions/d1/d1.messages.json", json.dumps({"messages": [{"id": "q", "role": "assistant", "ts": 9, "metrics": {"inputTokens": 4, "outputTokens": 1}}]}))
    put(".cline/data/sessions/d1/d1.json", json.dumps({"model": "hm"}))
    put("AppData/Roaming/Code/User/workspaceStorage/w/chatSessions/f.jsonl", json.dumps({"kind": 0, "v": {"requests": [{"requestId": "r", "timestamp": 1, "modelId": "gpt", "promptTokens": 2}]}}))
    put("AppData/Roaming/Code/User/workspaceStorage/w/workspace.json", json.dumps({"folder": "file:///c%3A/w"}))
    (tmp_path / ".lmstudio/conversations").mkdir(parents=True)
    put(".zcode/cli/db/db.sqlite", "not a database")
    (tmp_path / ".local/share/kilo").mkdir(parents=True)
    with sqlite3.connect(tmp_path / ".local/share/kilo/kilo.db") as db:
        db.execute("create table other (x)")
    put("out/stale.html", "")
    got = runs.usage_of(spark, registry.Home.of(str(tmp_path)), disabled={"copilot"}, out=str(tmp_path / "out"))
    status = got["status"]
    assert {a for a, s in status.items() if s == "Loaded"} == {"claude", "codex", "cline"}
    assert status["copilot"] == "Disabled" and status["lmstudio"] == status["kilo"] == "Empty" and status["zcode"].startswith("Failed") and status["hermes"] == "NotFound"
    totals = {r.agent: (r.input, r.output, r.requests) for r in got["totals"].collect()}
    assert totals["claude"] == (9.0, 17.0, 3.0) and totals["codex"] == (5.0, 0.0, 1.0) and totals[None] == (18.0, 18.0, 5.0)
    page = (tmp_path / "out/agents.html").read_text()
    assert "All agents" in page and not (tmp_path / "out/stale.html").exists()
    data = json.loads(page.split('id="data">')[1].split("</script>")[0])
    assert set(data["agents"]) == {"claude", "codex", "cline", "zcode", "kilo", "lmstudio", "copilot"} and len(data["sessions"]) == 3


def test_nothing_found(spark, tmp_path):
    got = runs.usage_of(spark, registry.Home.of(str(tmp_path)))
    assert got["records"] is None and set(got["status"].values()) == {"NotFound"}


def test_only_changed_logs_are_read_again(spark, tmp_path):
    logs, cache = tmp_path / "logs", str(tmp_path / "cache")
    (logs / "p").mkdir(parents=True)
    (logs / "p/a.jsonl").write_text(line(requestId="a") + "\n" + line(requestId="b"))
    (logs / "p/b.jsonl").write_text(line(requestId="c"))
    (logs / "empty.jsonl").write_text("")

    def load(rescan=False):
        rows, counts = registry.kept_transcripts(spark, [str(logs)], cache, rescan)
        assert rows.columns == registry.transcripts(spark, [str(logs)]).columns
        wanted = [r[:-1] for r in registry.transcripts(spark, [str(logs)]).orderBy("ord").collect()]
        assert [r[:-1] for r in rows.orderBy("ord").collect()] == wanted
        return counts, [r[9] for r in wanted]

    assert load() == ({"read": 3, "reused": 0}, ["a", "b", "c"])
    assert load() == ({"read": 0, "reused": 3}, ["a", "b", "c"])
    (logs / "p/b.jsonl").write_text(line(requestId="c") + "\n" + line(requestId="dd"))
    (logs / "p/aa.jsonl").write_text(line(requestId="e"))
    assert load() == ({"read": 2, "reused": 2}, ["a", "b", "e", "c", "dd"])
    (logs / "p/a.jsonl").unlink()
    assert load() == ({"read": 0, "reused": 3}, ["e", "c", "dd"])
    assert load(rescan=True) == ({"read": 3, "reused": 0}, ["e", "c", "dd"])
    assert len([n for n in (tmp_path / "cache/claude/records").iterdir() if n.name.startswith("part=")]) == 1


def test_usage_with_a_cache_is_the_same(spark, tmp_path):
    (tmp_path / ".claude/projects/p").mkdir(parents=True)
    (tmp_path / ".claude/projects/p/s.jsonl").write_text(line(requestId="a") + "\n" + line(requestId="b"))
    count = json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "event_msg", "payload": {
        "type": "token_count", "info": {"total_token_usage": {"total_tokens": 5}, "last_token_usage": {"input_tokens": 5}}}})
    for folder in ("sessions", "archived_sessions"):
        (tmp_path / ".codex" / folder).mkdir(parents=True)
        (tmp_path / ".codex" / folder / "rollout-1.jsonl").write_text(count.replace("00Z", "01Z") if folder == "sessions" else count)
    where, cache = registry.Home.of(str(tmp_path)), str(tmp_path / "cache")
    plain = runs.usage_of(spark, where)
    first, again = (runs.usage_of(spark, where, cache=cache) for _ in range(2))
    rows = lambda got: sorted(map(tuple, got["totals"].fillna("", ["agent"]).collect()))
    assert rows(plain) == rows(first) == rows(again)
    # The same name and running total in two folders: two files, two records.
    assert {r.agent: r.requests for r in plain["totals"].collect()}["codex"] == 2.0
    assert first["files"] == {"claude": {"read": 1, "reused": 0}, "codex": {"read": 2, "reused": 0}}
    assert again["files"] == {"claude": {"read": 0, "reused": 1}, "codex": {"read": 0, "reused": 2}}


def test_the_first_file_by_path_counts(spark, tmp_path):
    """A request that stands in several files: the copy in the first by path is the one that counts, for each agent."""

    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    names = "habdgcfe"
    for k, name in enumerate(names):
        n = ord(name)
        step = {"stepIdentifier": "1700-1", "genInfo": {"identifier": "m", "stats": {"promptTokensCount": n, "predictedTokensCount": 1}}}
        put(f".lmstudio/conversations/{name}.conversation.json", json.dumps({"messages": [{"versions": [{"role": "assistant", "steps": [step]}]}]}))
        put(f".cline/data/sessions/{name}/{name}.messages.json", json.dumps({"messages": [{"id": "q", "role": "assistant", "ts": 9, "metrics": {"inputTokens": n, "outputTokens": 1}}]}))
        log = {"kind": 0, "v": {"requests": [{"requestId": "r", "timestamp": 1, "modelId": "gpt", "promptTokens": n}]}}
        put(f"AppData/Roaming/Code/User/workspaceStorage/{name}/chatSessions/f.jsonl", json.dumps(log))
        (tmp_path / ".gemini/antigravity/conversations").mkdir(parents=True, exist_ok=True)
        with sqlite3.connect(tmp_path / f".gemini/antigravity/conversations/{name}.db") as db:
            db.execute("create table steps (idx, metadata)")
            blob = field(1, field(1, 100)) + field(9, field(1, 1) + field(2, n) + field(11, "same"))
            db.executemany("insert into steps values (?, ?)", [(0, None), (1, blob)][k % 2 :])
    where = registry.Home.of(str(tmp_path))
    for agent in ("lmstudio", "cline", "copilot", "antigravity"):
        rows = registry.LOADERS[agent](spark, where)
        assert [chr(int(r.input)) for r in rows.orderBy("ord").collect()] == sorted(names), agent
        assert usage.keep_first(rows).first().input == ord("a"), agent


def test_growing_logs(spark, tmp_path):
    """After every append, cut, replacement and deletion the kept records equal a full read, and appended bytes are all that is read."""
    logs, cache = tmp_path / ".codex/sessions", str(tmp_path / "cache")
    logs.mkdir(parents=True)
    (tmp_path / ".codex/archived_sessions").mkdir()
    where = registry.Home.of(str(tmp_path))
    token = lambda total, n: json.dumps({"timestamp": "2026-01-01T00:00:01Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": total}, "last_token_usage": {"input_tokens": n}}}}) + "\n"
    meta = lambda s, cwd: json.dumps({"type": "session_meta", "payload": {"id": s, "cwd": cwd}}) + "\n"
    turn = lambda m, cwd=None: json.dumps({"type": "turn_context", "payload": {"model": m, "cwd": cwd}}) + "\n"

    def load():
        rows, counts = registry.kept_codex(spark, where, cache)
        files = raw_files(cache, "codex")
        wanted = sorted(tuple(r)[:-1] for r in registry.LOADERS["codex"](spark, where).collect())
        got = rows.orderBy("ord").collect()
        assert sorted(tuple(r)[:-1] for r in got) == wanted
        assert [r.ord for r in got] == sorted({r.ord for r in got})
        return counts["read"], {os.path.basename(r.path): r.offset for r in files}, bytes_read(cache)

    a, b = logs / "rollout-a.jsonl", logs / "rollout-b.jsonl"
    a.write_text(meta("S", "/m") + token(5, 1) + turn("gpt-a", "/t"))
    b.write_text(token(7, 1))
    assert load()[0] == 2
    with a.open("a") as f:
        f.write(token(5, 2) + token(9, 3) + token(9, 4))  # the first repeats the total that stood before
    size = a.stat().st_size
    n, offsets, seen = load()
    assert n == 1 and offsets["rollout-a.jsonl"] == size and seen == len(token(5, 2) + token(9, 3) + token(9, 4))
    with a.open("a") as f:
        f.write(turn(None, "/u") + token(12, 3)[:-1])  # a line without its end counts, and is read again
    load()
    with a.open("a") as f:
        f.write("\n" + meta("other", "/x") + token(15, 1))
    assert load()[2] == len(token(12, 3) + meta("other", "/x") + token(15, 1))
    a.write_text(meta("S2", "/m") + token(1, 1))  # cut
    load()
    b.write_text(turn("new") + token(70, 1) + token(80, 2))  # longer, but not what it was
    assert load()[2] == b.stat().st_size
    a.unlink()
    (logs / "rollout-0.jsonl").write_text(token(3, 3))
    load()
    assert load()[0] == 0


def raw_files(cache, agent):
    import glob

    import pyarrow.parquet as pq

    state = json.load(open(f"{cache}/{agent}/state.json"))["files"]
    rows = [r for f in glob.glob(f"{cache}/{agent}/files-{state}/*.parquet") for r in pq.read_table(f).to_pylist()]
    return [type("File", (), r) for r in rows]


def bytes_read(cache):
    import glob

    import pyarrow.parquet as pq

    return sum(r["bytes"] for f in glob.glob(f"{cache}/codex/read-*/*.parquet") for r in pq.read_table(f, columns=["bytes"]).to_pylist())


def test_parts_are_written_together(spark, tmp_path, monkeypatch):
    from tallyforge.sources import record_cache

    monkeypatch.setattr(record_cache, "MOST_PARTS", 2)
    (tmp_path / "logs").mkdir()
    for n in range(4):
        with (tmp_path / "logs/a.jsonl").open("a") as f:
            f.write(line(requestId=f"r{n}") + "\n")
        rows, _ = registry.kept_transcripts(spark, [str(tmp_path / "logs")], str(tmp_path / "c"))
        assert [r.request for r in rows.orderBy("ord").collect()] == [f"r{k}" for k in range(n + 1)]
        assert len(list((tmp_path / "c/claude/records").glob("part=*"))) <= 2


def test_documents_and_databases_are_kept(spark, tmp_path):
    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    where, cache = registry.Home.of(str(tmp_path)), str(tmp_path / "cache")
    message = lambda n: json.dumps({"messages": [{"id": "q", "role": "assistant", "ts": 9, "metrics": {"inputTokens": n, "outputTokens": 1}}]})
    for d in "ab":
        put(f".cline/data/sessions/{d}/{d}.messages.json", message(ord(d)))
    db = tmp_path / "AppData/Local/hermes/state.db"
    db.parent.mkdir(parents=True)
    con = sqlite3.connect(db)
    con.execute("pragma journal_mode = wal")
    con.execute("create table sessions (id, model, started_at, input_tokens)")
    con.execute("insert into sessions values ('x', 'm', 1, 5)")
    con.commit()

    def load(agent):
        rows, counts = registry.kept(spark, agent, where, cache)
        plain = sorted(tuple(r) for r in registry.LOADERS[agent](spark, where).collect())
        assert sorted(tuple(r) for r in rows.collect()) == plain
        return counts, len(plain)

    assert load("cline") == ({"read": 2, "reused": 0}, 2) and load("hermes") == ({"read": 1, "reused": 0}, 1)
    assert load("cline") == ({"read": 0, "reused": 2}, 2) and load("hermes") == ({"read": 0, "reused": 1}, 1)
    put(".cline/data/sessions/a/a.json", json.dumps({"model": "hm"}))  # beside the messages: their model changes
    put(".cline/data/sessions/0/0.messages.json", message(7))
    con.execute("insert into sessions values ('y', 'm', 2, 6)")  # stands in the log only
    con.commit()
    assert load("cline") == ({"read": 2, "reused": 1}, 3) and load("hermes") == ({"read": 1, "reused": 0}, 2)
    con.close()

"""A usage run over many folders: few tasks list them, what the records come from is read once, odd lines count as before."""

from __future__ import annotations

import json

from tallyforge.operators import usage
from tallyforge.sources import agents, files


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(150):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.jsonl").write_text("x")
    (tmp_path / "top.jsonl").write_text("x")
    listed = files.source_tree(spark, {"p": str(tmp_path)}, max_bytes=-1).where("not is_dir")
    assert listed.rdd.getNumPartitions() <= files.SPREAD + 1
    assert sorted(r.path for r in listed.collect()) == sorted(["top.jsonl", *(f"d{k}/a.jsonl" for k in range(150))])


def test_best_copies_reads_its_rows_once(spark):
    rows = spark.range(4).selectExpr("if(id < 2, '', 'r') as request", "id as output", "id as ord")
    best = usage.best_copies(rows)
    assert best._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1
    assert sorted(map(tuple, best.select("request", "output", "pos").collect())) == [("", 0, 0), ("", 1, 1), ("r", 3, 2)]


def test_fields_of_other_kinds(spark):
    def line(message, **more):
        return json.dumps({"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "sessionId": "s", "requestId": 7, "pad": "x" * 80, "message": message} | more, separators=(",", ":"))

    usages = [{"input_tokens": 1.9, "output_tokens": "5", "cache_creation": "none", "cache_creation_input_tokens": 4, "output_tokens_details": [1]}, [1], "usage", None, {"cache_creation": None, "input_tokens": -2.5}]
    texts = [line({"model": "m", "id": "i", "usage": u}) for u in usages] + [line("usage"), line({"model": 3, "usage": {}}), '"usage" "type":"assistant"' + "x" * 80]
    lines = spark.createDataFrame([(t if '"usage"' in t else t + '"usage"', n) for n, t in enumerate(texts)], "line string, ord long")
    got = {r.ord: (r.input, r.cw5m, r.cw1h, r.output, r.thinking, r.session, r.request, r.branch) for r in agents.transcript_records(lines).collect()}
    assert got == {0: (1, 4, 0, 0, 0, "s", "i", ""), 4: (-2, 0, 0, 0, 0, "s", "i", "")}

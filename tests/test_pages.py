"""Report pages: written by tasks, cut at any length, published as a whole, the same content in every form."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import lenient_json  # noqa: F401
from tallyforge.plans import reports, runs
from tallyforge.sources import pages, registry

from .test_agents import line

TEXT = 'é"<b>\u2028 ,\n]);'


def rows_of(spark, n):
    df = spark.range(n).select(F.col("id"), F.lit(TEXT).alias("t"))
    row = pages.json_row(F.col("id"), F.col("t"), F.lit(None).cast("string"), F.array(F.col("id") / 2, F.lit(None)))
    return pages.section(df, F.when(F.col("id") % 3 == 0, "b").otherwise("a"), "sessions", row, number1=-F.col("id"))


@pytest.mark.parametrize("n,page_rows", [(0, 5), (1, 5), (40, 1), (40, 7), (40, 1000)])
def test_pages_of_any_length(spark, tmp_path, n, page_rows):
    folder = str(tmp_path / "r")
    pages.write(rows_of(spark, n), folder, {"a": {"meta": {"x": 1}}, "none": {"meta": {}}}, page_rows)
    wanted = {tab: [[i, TEXT, None, [i / 2, None]] for i in reversed(range(n)) if (i % 3 == 0) == (tab == "b")] for tab in "ab"}
    got = {"a": [], "b": []}
    for r in pages.read(spark, folder).orderBy("tab", "place").collect():
        assert r.place == len(got[r.tab])
        got[r.tab].append(json.loads(r.row))
    assert got == wanted
    told = pages.manifest(folder)
    assert told["a"]["meta"] == {"meta": {"x": 1}} and told["none"]["sections"] == {}
    listed = [p for tab in told.values() for s in tab["sections"].values() for p in s]
    assert {p["file"] for p in listed} == set(os.listdir(os.path.join(folder, "pages"))) and all(0 < p["rows"] <= page_rows for p in listed)
    doc = json.loads("".join(pages.document(folder, "a", ["sessions", "hours", "keys"])))
    assert doc == {"meta": {"x": 1}, "sessions": wanted["a"], "hours": {}, "keys": []}


def test_a_write_that_fails_leaves_the_report_before(spark, tmp_path):
    folder = str(tmp_path / "r")
    pages.write(rows_of(spark, 10), folder, {}, 3)
    before = pages.manifest(folder)
    bad = rows_of(spark, 10).withColumn("row", F.when(F.col("number1") == -9, F.raise_error(F.lit("no"))).otherwise(F.col("row")))
    with pytest.raises(Exception):
        pages.write(bad, folder, {}, 3)
    assert pages.manifest(folder) == before and pages.read(spark, folder).count() == 10
    pages.write(rows_of(spark, 4), folder, {}, 3)
    assert pages.read(spark, folder).count() == 4 and len(os.listdir(os.path.join(folder, "pages"))) == 2


def test_hours_are_nested():
    rows = [["d1", 0, "k", [1.0]], ["d1", 0, "l", [2.0]], ["d1", 5, "k", [3.0]], ["d2", 5, "k", [4.0]], ["d2", 6, "k", [5.0]]]
    assert json.loads("".join(pages.nested(iter(rows)))) == {"d1": {"0": {"k": [1.0], "l": [2.0]}, "5": {"k": [3.0]}}, "d2": {"5": {"k": [4.0]}, "6": {"k": [5.0]}}}
    assert "".join(pages.nested(iter([]))) == "{}"


def test_report_of_a_home(spark, tmp_path):
    """The assistant's page, a page an agent, the page of all and the dashboard have equal totals."""
    logs = tmp_path / ".claude/projects/p"
    logs.mkdir(parents=True)
    logs.joinpath("s.jsonl").write_text("\n".join([line(requestId="a"), line(requestId="a"), line(requestId="b", sessionId="s2")]))
    cline = tmp_path / ".cline/data/sessions/d1"
    cline.mkdir(parents=True)
    cline.joinpath("d1.messages.json").write_text(json.dumps({"messages": [{"id": "q", "role": "assistant", "ts": 9, "metrics": {"inputTokens": 1400, "outputTokens": 100}}]}))
    out = tmp_path / "out"
    (out / "agents").mkdir(parents=True)
    (out / "agents/gone.html").write_text("")
    got = runs.usage_of(spark, registry.Home.of(str(tmp_path)), out=str(out))
    assert {p.name for p in (out / "agents").iterdir()} == {"all.html", "claude.html", "cline.html"} - {"claude.html"}
    told = pages.manifest(str(out))
    assert set(told) == {"all", "cline", "report"}
    document = lambda tab, form: json.loads("".join(pages.document(str(out), tab, form)))
    everything, own, cline = document("all", reports.AGENT_FORM), document("report", reports.CLAUDE_FORM), document("cline", reports.AGENT_FORM)
    tokens = lambda doc, n: sum(sum(v[:n]) for hours in doc["hours"].values() for keys in hours.values() for v in keys.values())
    sums = {r.agent: r.input + r.cw + r.cr + r.output for r in got["totals"].collect()}
    assert tokens(everything, 4) == sums[None] and tokens(cline, 4) == sums["cline"] == 1500 and tokens(own, 5) == sums["claude"]
    assert own["meta"]["rawRecords"] == 3 and own["meta"]["countedRecords"] == 2 and own["meta"]["sessions"] == len(own["sessions"]) == 2
    assert list(own["rates"]) == own["models"] == list(own["appBasis"]) and own["appBasis"][own["models"][0]][5] == 3
    assert len(everything["sessions"]) == 3 and everything["keys"] == sorted(everything["keys"]) and cline["agents"] == {"cline": "Cline"}
    starts = [s[2] for s in everything["sessions"]]
    assert starts == sorted(starts)
    single = (out / "agents.html").read_text()
    assert json.loads(single.split('id="data">')[1].split("</script>")[0]) == everything
    shell = (out / "dashboard.html").read_text()
    assert shell.index('data-href="agents/all.html"') < shell.index('data-href="report.html"') < shell.index('data-href="agents/cline.html"') and "1.5K" in shell
    data = json.loads((out / "agents/cline.html").read_text().split('id="data">')[1].split("</script>")[0])
    assert all((out / "agents" / f).exists() for fs in data["files"].values() for f in fs)
    runs.unload(got)

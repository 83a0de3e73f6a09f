"""The daily log against a day-by-day model."""

import random

import pytest

from tallyforge.operators import dailylog

LINES = "date string, project_id string, name string, scanned_at long, scope string, tokenizer string, files long, bytes long, tokens long, physical long, blank long, code long, comment long, content long"
AI = "date string, tokens double, cost double, cost_partial boolean"


def random_log(seed):
    rng = random.Random(seed)
    days = [f"2026-01-{d:02d}" for d in range(1, 15)]
    lines, ai = [], []
    for d in days:
        for p in "abc":
            if rng.random() < 0.3:
                lines.append((d, p, p, len(lines), rng.choice(["SourceOnly", "AllText"]) if seed else "SourceOnly", rng.choice(["X", "y"]) if seed else "x", *[rng.randrange(50) for _ in range(8)]))
        if rng.random() < 0.5:
            ai.append((d, float(rng.choice([0, 5])), 1.0, False))
    return lines, ai


def timeline(lines, ai):
    latest, rows, previous, contract = {}, [], None, None
    usage = {a[0]: a for a in ai}
    for d in sorted({x[0] for x in lines} | set(usage)):
        today = [x for x in lines if x[0] == d]
        latest |= {x[1]: x for x in today}
        if not today and not (d in usage and usage[d][1] > 0):
            continue
        totals = [sum(c) for c in zip(*[x[6:] for x in latest.values()])] if latest else None
        now = "+".join(sorted({f"{x[4]}/{x[5].lower()}" for x in latest.values()})) if latest else None
        changed = now is not None and ("+" in now or (contract is not None and now != contract))
        rows.append((d, len(latest), len(latest) - len(today), totals, totals and previous and totals[3] - previous[3], usage[d][1] if d in usage else None, changed))
        if totals:
            previous, contract = totals, now
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_timeline(spark, seed):
    lines, ai = random_log(seed)
    got = dailylog.timeline(spark.createDataFrame(lines, LINES), spark.createDataFrame(ai, AI)).orderBy("date").collect()
    shown = [(r.date, r.projects, r.carried, [r[c] for c in dailylog.TOTALS] if r.files is not None else None, r.delta_physical, r.ai_tokens, r.scope_changed) for r in got]
    assert shown == timeline(lines, ai)


def test_merge_rules(spark):
    old = spark.createDataFrame([("1", 10.0, 1.0, False), ("2", 10.0, 1.0, False), ("3", 10.0, 1.0, False), ("4", 10.0, 1.0, False)], AI)
    new = spark.createDataFrame([("1", 9.0, 2.0, True), ("2", 10.0, 2.0, True), ("4", 1.0, 2.0, True), ("5", 0.0, 2.0, True)], AI)
    got = {r.date: (r.tokens, r.cost) for r in dailylog.record_ai(old, new, "4").collect()}
    assert got == {"1": (10.0, 1.0), "2": (10.0, 2.0), "3": (10.0, 1.0), "4": (1.0, 2.0), "5": (0.0, 2.0)}
    row = lambda at, n: ("d", "p", "n", at, "s", "t", n, 0, 0, 0, 0, 0, 0, 0)
    log = dailylog.record_lines(spark.createDataFrame([row(1, 5)], LINES), spark.createDataFrame([row(2, 6)], LINES))
    assert [r.files for r in log.collect()] == [6]


def test_project_usage(spark):
    ai = spark.createDataFrame([("1", 9.0, 2.0, False), ("2", 7.0, 1.0, False)], AI)
    parts = spark.createDataFrame([("1", "p", 4.0, 1.0, True), ("1", "q", 2.0, 0.5, False)], "date string, project_id string, tokens double, cost double, cost_partial boolean")
    some = dailylog.ai_by_day(ai, parts, ["p"], all_agents=False).orderBy("date").collect()
    assert [tuple(r) for r in some] == [("1", 4.0, 1.0, True), ("2", 0.0, 0.0, False)]
    assert [r.ai_tokens for r in dailylog.ai_by_day(ai, parts, ["p"], all_agents=True).orderBy("date").collect()] == [9.0, 7.0]


def test_comparison_and_texts(spark):
    lines = [("1", "p", "P", 0, "S", "T", 1, 0, 0, 1500, 0, 7, 0, 0), ("3", "p", "P", 0, "S", "T", 1, 0, 5, 1200, 0, 7, 0, 0)]
    df, ai = spark.createDataFrame(lines, LINES), spark.createDataFrame([("3", 2e6, 1234.5, True)], AI)
    rows = dailylog.compare_metrics(df, ai, "2", "3")
    got = {r.metric: (r.a, r.b, r.delta, r.delta_percent) for r in rows.collect()}
    assert got["Physical lines"] == (1500, 1200, -300, -0.2) and got["Tokens"] == (0, 5, 5, None) and got["AI cost (that day)"] == (None, 1234.5, None, None)
    text = {r.metric: tuple(r)[2:] for r in dailylog.compare_text(rows).collect()}
    assert text["Physical lines"] == ("1,500", "1,200", "-300", "-20.0%") and text["AI cost (that day)"] == ("—", "$1,234.50", "—", "—") and text["Files"] == ("1", "1", "0", "0.0%")
    a, b = dailylog.effective(df, "2"), dailylog.effective(df, "3")
    w = dailylog.warnings(a, b).first()
    assert (w.contracts, w.differ, w.carried_a, w.carried_b) == ("S/t", False, True, False)
    notes = [r.notes for r in dailylog.notes(dailylog.timeline(df, spark.createDataFrame([("0", 1.0, 0.0, False), ("2", 1.0, 0.0, False)], AI))).orderBy("date").collect()]
    assert notes == ["Not scanned yet", "", "Not scanned this day; latest earlier scan shown", ""]


def test_a_day_is_recorded(spark, tmp_path):
    from tallyforge.operators import usage
    from tallyforge.plans import runs

    sums = ["bytes", "tokens", "physical", "blank", "code", "comment", "content"]
    files = spark.createDataFrame([("p", *range(7)), ("p", *[10] * 7)], "project_id string, " + ", ".join(f"{c} long" for c in sums))
    names = spark.createDataFrame([("p", "P"), ("q", "Q")], "project_id string, name string")
    first = runs.record_day(files, names, None, "2024-01-01", 5, "AllText", "T")
    assert {(r.project_id, r.files, r.physical) for r in first.collect()} == {("p", 2, 12), ("q", 0, 0)}
    again = runs.record_day(files.limit(1), names, first, "2024-01-01", 6, "AllText", "T").collect()
    assert sorted((r.project_id, r.files) for r in again) == [("p", 1), ("q", 0)]
    day = 86_400_000
    record = lambda i, ts, cwd, n: ("a", ts, "m", float(n), 0.0, 0.0, 0.0, 0.0, 1.0, "s", f"r{i}", cwd, 1, i)
    kind = "agent string, ts long, model string, input double, cw double, cr double, output double, thinking double, cost double, session string, request string, cwd string, calls int, ord long"
    rows = spark.createDataFrame([record(0, 1, "/w/p/x", 5), record(1, day + 1, "/w/p", 7), record(2, day + 2, "/w/p", 2)], kind)
    roots = spark.createDataFrame([("p", "/w/p", 0), ("q", "/w/q", 1)], "project_id string, root_path string, ord int")
    load = lambda df: ({"cube": usage.agent_cube(df)}, df, roots)
    ai, parts = runs.record_usage(*load(rows), None, None, "1970-01-02")
    assert sorted((r.date, r.tokens) for r in ai.collect()) == [("1970-01-01", 5.0), ("1970-01-02", 9.0)]
    assert sorted((r.date, r.project_id, r.tokens) for r in parts.collect()) == [("1970-01-01", "p", 5.0), ("1970-01-02", "p", 9.0)]
    less = spark.createDataFrame([record(0, 1, "/w/q", 4), record(1, day + 1, "/w/q", 1)], kind)  # fewer tokens: only today is replaced
    ai, parts = runs.record_usage(*load(less), ai, parts, "1970-01-02")
    assert sorted((r.date, r.tokens) for r in ai.collect()) == [("1970-01-01", 5.0), ("1970-01-02", 1.0)]
    assert sorted((r.date, r.project_id, r.tokens) for r in parts.collect()) == [("1970-01-01", "p", 5.0), ("1970-01-02", "q", 1.0)]
    runs.daily_export(first, ai, str(tmp_path / "d.csv"))
    lines = (tmp_path / "d.csv").read_text(encoding="utf-8-sig").splitlines()
    assert lines[0].count(",") == 16 and [line[1:11] for line in lines[1:]] == ["1970-01-01", "1970-01-02", "2024-01-01"]

"""Queries over every row and whole texts leave nothing out."""

from pyspark.sql import functions as F

from tallyforge.operators import history
from tallyforge.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_event_is_a_scan(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert catalogue.scans(spark, SF).count() == events.count()
    assert catalogue.ai_days(spark, SF).groupBy().sum("cost").first()[0] == events.count()
    days = events.selectExpr("date_format(ts, 'yyyy-MM-dd') AS d", "user_id % 6 AS u", "day(ts) AS n").distinct().collect()
    want = {(r.d, f"u{0 if r.u == 1 and r.n % 5 == 0 else r.u}") for r in days}
    assert {(r.date, r.project_id) for r in catalogue.QUERIES["daily_upsert"](spark, SF).collect()} == want
    found = {r.project_id: r.is_carried for r in catalogue.QUERIES["daily_effective"](spark, SF).collect()}
    assert set(found) == {f"u{k}" for k in range(6)} and found["u1"]


def test_the_whole_window_is_sniffed(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, behind, late = {}, 0, 0
    for i, text in docs.items():
        at = 4000 if i % 4 == 1 else 9000
        data = (text[:at] + "\x01\x02" * (i % 300 if i % 4 in (1, 3) else 0) + text[at:]).encode() + b"\x00" * (i % 7 == 0)
        head = data[:8192]
        want[i] = 0 in head or sum(b < 8 or b in (11, 12, 14, 15) or 16 <= b < 32 for b in head) > len(head) // 20
        behind += 0 in data and 0 not in head
        late += want[i] and len(text) > 4000
    assert behind and late
    assert {r.doc_id: r.binary for r in catalogue.QUERIES["binary_sniff"](spark, SF).collect()} == want


def test_whole_texts_are_escaped(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert any(c in t[40:] for t in docs.values() for c in '"<>&')
    for r in catalogue.QUERIES["csv_guard_html_escape"](spark, SF).collect():
        s = ["=", "+", "-", "@", "\t", 'x"', "<b>&"][r.doc_id % 7] + docs[r.doc_id]
        assert r.cell == '"' + ("'" * (r.doc_id % 7 < 5) + s).replace('"', '""') + '"'
        assert r.html == s.replace("&", "&#38;").replace("<", "&#60;").replace(">", "&#62;").replace('"', "&#34;")


def test_every_line_is_compared(spark):
    rows = {r.language: r for r in catalogue.QUERIES["daily_compare_languages"](spark, SF).collect()}
    want = {r.lang: r.n for r in catalogue.doc_metrics(spark, SF).groupBy("lang").agg({"physical": "sum"}).toDF("lang", "n").collect()}
    assert {k: r.lines_a + r.lines_b for k, r in rows.items()} == want
    assert rows["de"].lines_a == 0 < rows["de"].lines_b


def test_every_file_is_exported(spark):
    files, projects = catalogue.history_rows(spark, SF)
    rows = catalogue.QUERIES["export_with_status"](spark, SF).where("record_type = 'File'")
    assert sorted((r.project, r.path) for r in rows.collect()) == sorted((r.project_id, r.path) for r in files.collect())
    total = history.grand_totals(projects)
    some = history.export_rows(projects.withColumn("status", F.lit("OK")), files.where("project_id <> 'r3'"), total).where("project = 'r3'").collect()
    assert [(r.record_type, r.path) for r in some] == [("ProjectStatus", None)]


def test_sums_of_prices_do_not_depend_on_their_order(spark, tmp_path):
    """0.5 exactly, which doubles added in this order miss."""
    rows = [(3, 0.03), (3, 0.29), (3, 0.18)]
    assert 0.03 + 0.29 + 0.18 < 0.5
    spark.createDataFrame(rows, "l_partkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.l_partkey: r.text for r in catalogue.QUERIES["format_tokens"](spark, str(tmp_path)).collect()} == {3: "1"}


def test_changes_are_joined_once(spark):
    """One join of changes with commits in git_activity; files are kept, so that projects and totals join no changes again."""
    plan = catalogue.QUERIES["git_activity"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == 1
    files = catalogue.history_rows(spark, SF)[0]
    assert files.storageLevel.useMemory and files.storageLevel.useDisk
    files.unpersist()

"""Whole runs published at once, and runs that are watched and called off."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import progress, publication, runs
from tallyforge.sources import registry

from .test_agents import line

TABLES = ["files", "warnings", "snapshot", "lines", "languages", "ai", "ai_projects"]


@pytest.fixture
def home(tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web/a.py").write_text("x = 1\n# c\n")
    (tmp_path / "api").mkdir()
    (tmp_path / "api/b.cs").write_text("int x;\n")
    logs = tmp_path / "home/.claude/projects/p"
    logs.mkdir(parents=True)
    (logs / "s.jsonl").write_text(line(cwd=str(tmp_path / "web")))
    return tmp_path


def projects(home):
    return [runs.Project("w", "Web", str(home / "web")), runs.Project("a", "Api", str(home / "api")), runs.Project("off", "Off", str(home), enabled=False)]


def contents(spark, state):
    p = publication.Publication(spark, state)
    return {t: None if p.read(t) is None else sorted(map(str, p.read(t).collect())) for t in TABLES}


def test_a_run_publishes_all(spark, home):
    state, where = str(home / "state"), registry.Home.of(str(home / "home"))
    runs.refresh(spark, projects(home), state, "2026-01-02", 10, where=where)
    p = publication.Publication(spark, state)
    assert {(r.project_id, r.files, r.code) for r in p.read("lines").collect()} == {("w", 1, 1), ("a", 1, 1)}
    assert {(r.project_id, r.language) for r in p.read("languages").collect()} == {("w", "Python"), ("a", "C#")}
    assert [(r.date, r.tokens) for r in p.read("ai").collect()] == [("2026-01-02", 18.0)]
    (home / "web/c.py").write_text("y = 2\n")
    (home / "api/b.cs").unlink()
    (home / "api").rmdir()
    runs.refresh(spark, projects(home), state, "2026-01-03", 20, where=where)
    assert {(r.date, r.project_id, r.files) for r in p.read("lines").collect()} == {("2026-01-02", "w", 1), ("2026-01-02", "a", 1), ("2026-01-03", "w", 2)}
    assert {(r.project_id, r.files, r.scanned_at) for r in p.read("snapshot").collect()} == {("w", 2, 20), ("a", 1, 10)}
    assert [(r.project_id, r.warning) for r in p.read("warnings").collect()] == [("a", "folder not found")]
    assert len([n for n in os.listdir(state) if n.startswith("v-")]) == 1


def test_a_run_that_dies_leaves_the_state_before(spark, home, monkeypatch):
    state, where = str(home / "state"), registry.Home.of(str(home / "home"))
    runs.refresh(spark, projects(home), state, "2026-01-02", 10, where=where)
    before = contents(spark, state)
    (home / "web/a.py").write_text("x = 1\ny = 2\n")
    write = publication.Draft.write
    for dies_at in ("lines", "ai_projects", "commit"):

        def dying(self, name, df):
            if name == dies_at:
                raise KeyboardInterrupt
            return write(self, name, df)

        with monkeypatch.context() as m:
            m.setattr(publication.Draft, "write", dying)
            if dies_at == "commit":
                m.setattr("tallyforge.sources.sinks.write_document", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
            with pytest.raises(KeyboardInterrupt):
                runs.refresh(spark, projects(home), state, "2026-01-03", 20, where=where if dies_at == "ai_projects" else None)
        assert len([n for n in os.listdir(state) if n.startswith("v-")]) == 1
    assert contents(spark, state) == before


def test_two_runs_at_once(spark, tmp_path):
    p = publication.Publication(spark, str(tmp_path))
    with p.draft() as one:
        one.write("t", spark.range(3))
    with pytest.raises(publication.Conflict), p.draft() as late:
        with p.draft() as first:
            first.write("u", spark.range(4))
        late.write("t", spark.range(9))
    assert p.read("t").count() == 3 and p.read("u").count() == 4
    assert len([n for n in os.listdir(tmp_path) if n.startswith("v-")]) == 2
    (tmp_path / "v-dead/t").mkdir(parents=True)
    with p.draft() as more:
        more.write("t", spark.range(1))
    assert p.read("t").count() == 1 and p.read("u").count() == 4 and not (tmp_path / "v-dead").exists()


def test_progress_and_cancelling(spark, tmp_path):
    p = publication.Publication(spark, str(tmp_path))
    slow = F.udf(lambda x: time.sleep(0.3) or x, "long")

    def work():
        with p.draft() as draft:
            draft.write("t", spark.range(0, 400, 1, 100).select(slow("id").alias("x")))

    run = progress.Run(spark, work)
    seen = None
    for _ in range(200):
        seen = run.progress()
        if seen.remaining is not None:
            break
        time.sleep(0.1)
    assert seen.state == "running" and seen.jobs == 1 and seen.tasks == 100 and 2 <= seen.finished < 100 and seen.remaining > 0
    run.cancel()
    assert run.progress().state == "cancelled" and not [n for n in os.listdir(tmp_path) if n.startswith("v-")]
    for _ in range(50):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    with pytest.raises(progress.Cancelled):
        run.result()
    assert spark.range(5).count() == 5 and p.read("t") is None  # other work goes on
    done = progress.Run(spark, lambda: spark.range(7).count())
    assert done.result(60) == 7 and done.progress().state == "done"
    failed = progress.Run(spark, lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failed.result(60)
    assert failed.progress().state == "failed" and progress.estimate(1, 9, 5.0) is None and progress.estimate(2, 8, 4.0) == 12.0


def test_a_thread_of_its_own(spark):
    """Jobs of others do not carry the tag."""
    hold = threading.Event()
    run = progress.Run(spark, lambda: hold.wait(30))
    spark.range(3).count()
    assert run.progress().jobs == 0
    hold.set()
    assert run.result(30) is True

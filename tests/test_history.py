"""Version history over repositories made here."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import history
from tallyforge.plans import runs
from tallyforge.sources import repos as sources


class Repo:
    def __init__(self, path):
        self.path, self.time = path, 1_700_000_000
        path.mkdir(parents=True)
        self("init", "-q", "-b", "main")

    def __call__(self, *args):
        env = os.environ | {"GIT_AUTHOR_DATE": f"{self.time} +0000", "GIT_COMMITTER_DATE": f"{self.time} +0000", "GIT_CONFIG_GLOBAL": "/dev/null"}
        who = ["-c", "user.name=t", "-c", "user.email=t@example.org", "-c", "commit.gpgsign=false"]
        return subprocess.run(["git", "-C", str(self.path), *who, *args], check=True, capture_output=True, env=env).stdout.decode()

    def commit(self, files, step=100):
        for name, data in files.items():
            f = self.path / name
            f.parent.mkdir(parents=True, exist_ok=True)
            if data is None:
                f.unlink()
            else:
                f.write_bytes(data.encode() if isinstance(data, str) else data)
        self("add", "-A")
        self("commit", "-q", "--allow-empty", "-m", "c")
        self.time += step
        return self.time - step


def by_path(report):
    return {r.path: (r.added, r.deleted, r.modified, r.binary) for r in report["files"].collect()}


@pytest.fixture
def repo(tmp_path):
    return Repo(tmp_path / "r")


def test_activity(spark, repo):
    body = "".join(f"line {i}\n" for i in range(30))
    first = repo.commit({"a.cs": "1\n2\n3\n", "Ünï.py": "x\n", "keep.md": "t\n", "old.cs": body})
    repo.commit({"a.cs": "1\nTWO\n3\n"})
    repo.commit({"a.cs": "1\n2\n3\n", "b.cs": b"\0\1"})
    repo.commit({"old.cs": None, "new.cs": body})
    last = repo.commit({"new.cs": None, "gone.txt": body})
    report = runs.history_report(spark, {"p": str(repo.path)}, first, last)
    assert by_path(report) == {
        "a.cs": (5, 2, 2, False), "Ünï.py": (1, 0, 0, False), "old.cs": (30, 0, 0, False), "b.cs": (0, 0, 0, True), "new.cs": (0, 30, 0, False),
    }
    p = report["projects"].first()
    assert (p.commits, p.changed_files, p.binary_files, p.net) == (5, 5, 1, 36 - 32)
    t = report["totals"].first()
    assert (t.projects, t.commits, t.added, t.deleted) == (1, 5, 36, 32)
    assert [r.path for r in report["files"].collect()][0] in ("old.cs", "new.cs")
    later = runs.history_report(spark, {"p": str(repo.path)}, first + 1, last)
    assert by_path(later)["a.cs"] == (2, 2, 2, False) and later["projects"].first().commits == 4


def test_baseline_and_empty(spark, repo, tmp_path):
    a = repo.commit({"a.cs": "1\n"})
    b = repo.commit({"a.cs": "2\n"})
    log = sources.git_log(spark, {"p": str(repo.path), "none": str(tmp_path)})
    rows = log.orderBy("ord").collect()
    assert [r.ts for r in rows] == [b, a] and rows[1].parent is None and rows[0].parent == rows[1].hash
    assert history.baseline(log, F.lit(b)).first().hash == rows[1].hash
    assert history.baseline(log, F.lit(a)).first().hash is None
    empty = Repo(tmp_path / "e")
    assert sources.git_log(spark, {"e": str(empty.path)}).count() == 0


def test_shallow_boundary(spark, repo, tmp_path):
    repo.commit({"a.cs": "1\n" * 50})
    last = repo.commit({"a.cs": "1\n" * 51})
    subprocess.run(["git", "clone", "-q", "--depth", "1", f"file://{repo.path}", str(tmp_path / "s")], check=True, capture_output=True)
    report = runs.history_report(spark, {"p": str(tmp_path / "s")}, 0, last)
    assert by_path(report) == {} and report["projects"].first().commits == 1


def test_merges_count_by_first_parent(spark, repo):
    start = repo.commit({"a.cs": "1\n"})
    repo("checkout", "-q", "-b", "side")
    repo.commit({"b.cs": "x\ny\n"})
    repo("checkout", "-q", "main")
    repo.commit({"c.cs": "z\n"})
    repo("merge", "-q", "--no-ff", "-m", "m", "side")
    report = runs.history_report(spark, {"p": str(repo.path)}, start, repo.time)
    assert by_path(report) == {"a.cs": (1, 0, 0, False), "b.cs": (2, 0, 0, False), "c.cs": (1, 0, 0, False)}
    assert report["projects"].first().commits == 3


def estimate(patch):
    total = plus = minus = 0
    inside = False
    for line in patch.split("\n"):
        head = line.startswith("@@ ") or line.startswith("diff --git ")
        if inside and not head and line[:1] in "+-" and line:
            plus, minus = plus + (line[0] == "+"), minus + (line[0] == "-")
            continue
        if not line.startswith("\\ No newline") or head:
            total, plus, minus = total + min(plus, minus), 0, 0
        if head:
            inside = line.startswith("@@ ")
    return total + min(plus, minus)


def test_modified_estimate(spark):
    rng = random.Random(2)
    lines = ["@@ -1 +1 @@", "diff --git a/x b/x", "+a", "-b", "+a", "-b", " c", "", "\\ No newline at end of file", "--- a/x", "+++ b/x", "index"]
    patches = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(patches)), "id int, patch string")
    assert {r.id: r.modified for r in history.modified_estimate(df, ["id"]).collect()} == {i: estimate(p) for i, p in enumerate(patches)}


def test_numstat(spark):
    text = "1\t2\ta b.cs\0" + "3\t4\t\0old.cs\0new\tname.cs\0" + "-\t-\tbin\0" + "0\t0\t\0o\0n\0"
    rows = history.numstat_entries(spark.createDataFrame([("p", "h", text), ("p", "e", "")], "project_id string, hash string, output string")).collect()
    assert [tuple(r)[2:] for r in rows] == [
        ("a b.cs", None, 1, 2, False), ("new\tname.cs", "old.cs", 3, 4, False), ("bin", None, 0, 0, True), ("n", "o", 0, 0, False),
    ]


def test_days_and_status(spark):
    assert history.check_days(1) == 1 and history.check_days(36500) == 36500
    for bad in (0, 36501):
        with pytest.raises(ValueError):
            history.check_days(bad)
    rows = [(0, False, False, False), (3, True, True, False), (3, True, False, False), (3, False, False, False)]
    df = spark.createDataFrame(rows, "n int, s boolean, b boolean, h boolean")
    got = df.select(history.status(*map(F.col, "nsbh"), "Activity").alias("a"), history.status(*map(F.col, "nsbh"), "NetChange").alias("n")).collect()
    assert [r.a for r in got] == ["No commits", "Incomplete: shallow boundary excluded", "Incomplete: shallow local history", None]
    assert got[1].n == "Unavailable: period starts before available shallow history" and got[3].n is None


def test_net_change_and_export(spark, repo, tmp_path):
    repo.commit({"a.cs": "1\n2\n3\n", "gone.cs": "x\n"})
    start = repo.commit({"a.cs": "1\nTWO\n3\n", "tmp.cs": "y\n"})
    repo.commit({"tmp.cs": None, "gone.cs": None})
    end = repo.commit({"a.cs": "1\n2\n3\n4\n"})
    report = runs.history_report(spark, {"p": str(repo.path)}, start, end, mode="NetChange")
    assert by_path(report) == {"a.cs": (1, 0, 0, False), "gone.cs": (0, 1, 0, False)}
    p = report["projects"].first()
    assert (p.commits, p.changed_files, p.net, p.status) == (None, 2, 0, None) and p.head == repo("rev-parse", "HEAD").strip()
    whole = runs.history_report(spark, {"p": str(repo.path)}, 0, end, mode="NetChange")  # no commit before: all that is there
    assert by_path(whole) == {"a.cs": (4, 0, 0, False)}
    none = runs.history_report(spark, {"p": str(repo.path)}, end + 1, end + 2, mode="NetChange")
    assert none["files"].count() == 0 and none["projects"].first().status == "No commits"
    runs.history_export(report, str(tmp_path / "h.csv"), "main", start, end, "NetChange")
    lines = (tmp_path / "h.csv").read_text(encoding="utf-8-sig").splitlines()
    assert lines[0].count(",") == 17 and len(lines) == 4 and all(line.count('","') == 17 for line in lines[1:])
    assert any(f'"{p.head}"' in line and '"NetChange"' in line for line in lines[1:])


def test_ranges_of_one_repository(spark, repo, tmp_path):
    """The same rows in many tasks as in one; ranges outside the window are no task."""
    rng, times, body = random.Random(9), [], {f"f{k}.cs": [f"{k} {i}" for i in range(20)] for k in range(4)}
    for n in range(40):
        k = f"f{rng.randrange(4)}.cs"
        body[k][rng.randrange(20)] = f"changed {n}"
        times.append(repo.commit({k: "\n".join(body[k]) + "\n"} if n % 7 else {}))
        if n == 20:
            repo("mv", "f0.cs", "moved.cs")
            body["moved.cs"] = body.pop("f0.cs")
            body["f0.cs"] = ["new"] * 20
    where = {"p": str(repo.path), "none": str(tmp_path)}
    for form in sources.FORMS:
        one, many = (sources.git_diff(spark, where, form=form, commits=size) for size in (1000, 4))
        rows = sorted(map(tuple, one.collect()))
        assert len(rows) == 40 and rows == sorted(map(tuple, many.collect()))
        assert (one.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (1, 10)
        empty = subprocess.run(["git", "-C", str(repo.path), "hash-object", "-t", "tree", "/dev/null"], check=True, capture_output=True).stdout.decode().strip()
        log = {r.hash: r.parent for r in sources.git_log(spark, where, commits=7).collect()}
        assert len(log) == 40
        for _, commit, output in rows:  # as the porcelain has it
            assert output == repo("diff", *sources.FORMS[form], *sources.PLAIN, log[commit] or empty, commit)
    few = sources.git_diff(spark, where, times[-3], times[-1], commits=4)
    assert few.count() == 3 and few.rdd.getNumPartitions() == 1
    assert [r.ord for r in sources.git_log(spark, where, commits=7).orderBy("ord").collect()] == list(range(40))


def test_a_report_is_the_same_by_ranges(spark, repo, monkeypatch):
    rng, times = random.Random(4), []
    for n in range(25):
        times.append(repo.commit({f"s/f{rng.randrange(3)}.cs": "".join(f"{rng.randrange(9)}\n" for _ in range(12))}))
    whole = by_path(runs.history_report(spark, {"p": str(repo.path)}, times[2], times[-2]))
    monkeypatch.setattr(sources, "COMMITS", 3)
    monkeypatch.setattr(sources.git_diff, "__defaults__", (0, 1 << 60, "renames", 3))
    assert by_path(runs.history_report(spark, {"p": str(repo.path)}, times[2], times[-2])) == whole and len(whole) == 3


def test_ranges_are_found_by_tasks_and_diffed_once(spark, repo, tmp_path, monkeypatch):
    """The driver asks no repository for anything; ranges are dealt out by number, and the plain diff is made only where something was renamed."""
    repo.commit({"a.cs": "x\ny\nz\n" * 5, "b.cs": "1\n"})
    repo("mv", "a.cs", "c.txt")
    first = repo.commit({"b.cs": "2\n"})
    last = repo.commit({"b.cs": "3\n"})
    where = {"p": str(repo.path), "none": str(tmp_path)}
    monkeypatch.setattr(sources, "git", None)
    commits, diffs = sources.read_history(spark, where, first, last, size=1)
    assert commits.count() == 3 and diffs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.undo()
    for form in sources.FORMS:
        want = {r.hash: r.output for r in sources.git_diff(spark, where, first, last, form=form).collect()}
        got = {r.hash: r[form] for r in diffs.collect()}
        renamed = {r.hash for r in diffs.collect() if "\t\0" in r.renames}
        assert len(renamed) == 1 and len(got) == 2
        assert got == {h: want[h] if form != "plain" or h in renamed else "" for h in want}
    runs.unload({"loaded": [commits, diffs]})

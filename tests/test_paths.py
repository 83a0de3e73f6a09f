"""Classification, ignore rules and whole scans over trees made here."""

import os
import re
import struct

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dims
from tallyforge.operators import metrics, paths
from tallyforge.plans import runs
from tallyforge.sources import files as raw
from tallyforge.sources import tree as tree_source


def test_classification(spark):
    cases = {
        "a/B.CS": "C#", "x.cshtml": "Razor", "Makefile": "Build Script", "sub/dockerfile": "Build Script", "k.H": "C/C++", ".editorconfig": "INI", "a.json": "JSON",
        "r.R": "R", "README.md": "Markdown", "n.log": "Text", "odd.xyz": "Plain Text", "noext": "Plain Text", "x.": "Plain Text", "a.tar.py": "Python", "dir.cs/file": "Plain Text",
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.language for r in paths.classify(df, "AllText").collect()} == cases
    source = {r.path for r in paths.classify(df, "SourceOnly").collect()}
    assert source == {p for p, n in cases.items() if n in {x[0] for x in dims.LANGUAGES if x[1] == dims.SOURCE}}
    both = {r.path for r in paths.classify(df, "SourceAndConfiguration").collect()}
    assert both - source == {".editorconfig", "a.json"}


@pytest.mark.parametrize(
    "glob,yes,no",
    [
        ("*.cs", ["a.cs", ".cs"], ["a/b.cs", "a.csx"]), ("**/x", ["x", "a/x", "a/b/x"], ["ax"]), ("a/**", ["a/", "a/b/c"], ["a"]), ("f?.t", ["f1.t"], ["f/.t", "f.t"]),
        ("a**b", ["ab", "a/x/b"], ["a"]), ("[ab]", ["[ab]"], ["a"]), ("a.b", ["a.b"], ["axb"]),
    ],
)
def test_globs(glob, yes, no):
    rx = re.compile(f"^{paths.glob_regex(glob)}$")
    assert all(rx.match(p) for p in yes) and not any(rx.match(p) for p in no)


def decide(spark, rows, rules):
    df = spark.createDataFrame([("p", p, p.endswith("/")) for p in rows], "project_id string, path string, is_dir boolean").withColumn("path", F.rtrim("path", F.lit("/")))
    return {r.path for r in paths.ignored(df, rules, ["path"]).where("ignored").collect()}


def test_last_match_wins(spark):
    rules = paths.rules_frame(spark, ["# note", "", "*.tmp", "!keep.tmp", "bin/", "\\#x", "/top", "a/b.c"], own=[("p", ["keep.tmp"]), ("other", ["*"])])
    rows = ["x.tmp", "s/x.tmp", "keep.tmp", "bin/", "bin", "s/bin/", "s/bin/f", "#x", "top", "s/top", "a/b.c", "s/a/b.c", "free"]
    assert decide(spark, rows, rules) == {"x.tmp", "s/x.tmp", "keep.tmp", "bin", "s/bin", "s/bin/f", "#x", "top", "a/b.c"}


def test_nested_ignore_files(spark):
    rules = paths.rules_frame(spark, [], files=[("p", "sub", ["gen.cs", "/here.cs", "d/e"]), ("p", "", ["!sub/x/gen.cs"])])
    rows = ["gen.cs", "sub/gen.cs", "sub/x/gen.cs", "sub/here.cs", "here.cs", "sub/d/e", "sub/x/d/e", "subway/here.cs"]
    # A name without a slash in a nested file takes deeper files only, not those beside it.
    assert decide(spark, rows, rules) == {"sub/x/gen.cs", "sub/here.cs", "sub/d/e"}


@pytest.fixture
def tree(tmp_path):
    def put(path, data="x\n"):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data.encode() if isinstance(data, str) else data)

    put(".git/config")
    put("bin/generated.cs")
    put(".gitignore", "ignored.cs\nlogs/\n")
    put("Program.cs", "// c\nint x; // y\n\n")
    put("settings.json", "{}\n")
    put("README.md", "# t\n\nbody\n")
    put("ignored.cs")
    put("logs/!keep.cs")
    put("binary.unknown", bytes(range(5)))
    put("nested/.git/HEAD")
    put("nested/In.cs")
    put("big.cs", "y" * 5000)
    put("latin.cs", b"\xe9\n")
    return tmp_path


@pytest.mark.parametrize(
    "scope,want",
    [("SourceOnly", {"Program.cs"}), ("SourceAndConfiguration", {"Program.cs", "settings.json"}), ("AllText", {"Program.cs", "settings.json", "README.md", ".gitignore"})],
)
def test_scan(spark, tree, scope, want):
    found, warnings = runs.scan(spark, {"p": str(tree), "gone": str(tree / "nowhere")}, scope, max_bytes=4000)
    rows = {r.path: r for r in found.collect()}
    assert set(rows) == want
    p = rows["Program.cs"]
    assert (p.physical, p.code, p.comment, p.mixed, p.blank, p.extension) == (3, 1, 1, 1, 1, ".cs")
    told = {(r.project_id, r.path, r.warning) for r in warnings.collect()}
    assert told == {("p", "big.cs", "larger than the size limit"), ("p", "nested", "nested repository skipped"), ("p", "latin.cs", "not decodable"), ("gone", "", "folder not found")}


def test_rollups(spark, tree):
    found, _ = runs.scan(spark, {"p": str(tree)}, "AllText", max_bytes=4000)
    by = {r.language: (r.files, r.lines) for r in metrics.by_language(found, "project_id").collect()}
    assert by["C#"] == (1, 1) and by["Markdown"] == (1, 2)
    total = metrics.rollup(found, "project_id", "category").where("project_id is null").first()
    assert total.files == 4
    shares = metrics.shares(metrics.by_language(found, "project_id")).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(1.0)


def test_source_tree_sees_dot_names(spark, tree):
    names = {r.path for r in raw.source_tree(spark, {"p": str(tree)}).collect()}
    assert {".gitignore", ".git", ".git/config", "nested/.git/HEAD"} <= names
    some = raw.source_tree(spark, {"p": str(tree)}, names=r"\.md$", prune=r"^\.git$").where("not is_dir").collect()
    assert [(r.path, bytes(r.content)) for r in some] == [("README.md", b"# t\n\nbody\n")]


def test_below_any(spark):
    df = spark.createDataFrame([("a/b/c",), ("a/bc",), ("x",)], "path string")
    assert [r.path for r in paths.below_any(df, spark.createDataFrame([("a/b",)], "path string")).collect()] == ["a/b/c"]


def test_manifest_and_new_projects(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, length long, modified long")
    old = spark.createDataFrame([("a", 1, 1, "v"), ("b", 2, 9, "v"), ("c", 3, 3, "w")], "path string, length long, modified long, version string")
    changed, same = metrics.manifest_diff(old, now, "v")
    assert {r.path for r in changed.collect()} == {"b", "c"} and {r.path for r in same.collect()} == {"a"}
    assert metrics.manifest_diff(old, now, "v", rescan=True)[1].count() == 0
    have = spark.createDataFrame([("k1",)], "root_key string")
    add = spark.createDataFrame([("k1", "n", 0), ("k2", "m", 1), ("k2", "o", 2)], "root_key string, name string, ord int")
    assert [r.name for r in metrics.new_projects(have, add).collect()] == ["m"]


class Opened:
    """How often files below a folder are opened, as the kernel counts it."""

    OPEN, IS_DIR = 0x20, 0x40000000

    def __init__(self, root):
        import ctypes

        self.libc, self.names, self.found = ctypes.CDLL(None, use_errno=True), {}, {}
        self.fd = self.libc.inotify_init1(0o4000)
        for folder, _, _ in list(os.walk(root)):
            self.names[self.libc.inotify_add_watch(self.fd, folder.encode(), self.OPEN)] = os.path.relpath(folder, root)

    def counts(self):
        try:
            while data := os.read(self.fd, 1 << 16):
                while data:
                    wd, mask, _, n = struct.unpack("iIII", data[:16])
                    name = data[16 : 16 + n].rstrip(b"\0").decode()
                    key = os.path.normpath(os.path.join(self.names[wd], name)) + "/" * bool(mask & self.IS_DIR)
                    self.found[key] = self.found.get(key, 0) + 1
                    data = data[16 + n :]
        except BlockingIOError:
            return self.found


def scans_of(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BatchScan")


def test_a_scan_lists_once_and_opens_only_what_counts(spark, tree):
    (tree / "node_modules/dep").mkdir(parents=True)
    (tree / "node_modules/dep/x.cs").write_text("x\n")
    (tree / "deep/a/b/c").mkdir(parents=True)
    (tree / "deep/a/b/c/F.cs").write_text("x\n")
    (tree / "deep/a/.gitignore").write_text("b/skip*\n!Keep.cs\n*.gen.cs\n")
    (tree / "deep/a/b/skipped").mkdir()
    (tree / "deep/a/b/skipped/S.cs").write_text("x\n")
    (tree / "deep/a/b/c/x.gen.cs").write_text("x\n")
    seen = Opened(tree)
    found, warnings = runs.scan(spark, {"p": str(tree)}, "SourceOnly", excludes=["node_modules/", ".git/", "bin/"], max_bytes=4000)
    assert scans_of(found) == 1 and scans_of(warnings) == 2
    assert {r.path for r in found.collect()} == {"Program.cs", "deep/a/b/c/F.cs"}
    opened = seen.counts()
    assert {k: n for k, n in opened.items() if not k.endswith("/") and not k.endswith(".gitignore")} == {"Program.cs": 1, "latin.cs": 1, "deep/a/b/c/F.cs": 1}
    shut = ("node_modules/", ".git/", "bin/", "logs/", "nested/", "deep/a/b/skipped/")
    assert not any(k.startswith(shut) for k in opened)


def test_listing_is_dealt_out(spark, tmp_path):
    """The same listing by one task or many; a filter on the project opens no other root."""
    for k in range(30):
        (tmp_path / f"r/d{k % 5}/e{k}").mkdir(parents=True)
        (tmp_path / f"r/d{k % 5}/e{k}/f{k}.py").write_text("x")
    (tmp_path / "r/d1/.gitignore").write_text("/e1/\n")
    other = tmp_path / "other"
    other.mkdir()
    whole = {(r.path, r.state) for r in tree_source.listing(spark, {"p": str(tmp_path / "r")}, [], spread=1).collect()}
    assert len(whole) == 30  # with the ignore file, without e1
    for spread in (3, 7, 100):
        df = tree_source.listing(spark, {"p": str(tmp_path / "r")}, [], spread=spread)
        rows = df.collect()
        assert len(rows) == 30 and {(r.path, r.state) for r in rows} == whole
        assert (df.rdd.getNumPartitions() > 1) == (spread < 36)
    seen = Opened(tmp_path)
    both = tree_source.listing(spark, {"p": str(tmp_path / "r"), "q": str(other), "gone": "/no/where"}, [])
    assert both.where("project_id = 'q'").count() == 0 and both.where("project_id in ('gone', 'q')").collect()[0].state == "absent"
    assert not [k for k in seen.counts() if k.startswith("r/")]


def test_own_patterns_come_last(spark, tree):
    found, _ = runs.scan(spark, {"p": str(tree), "q": str(tree)}, "SourceOnly", own=[("p", ["!ignored.cs", "Program.cs"])], max_bytes=4000)
    assert {(r.project_id, r.path) for r in found.collect()} == {("p", "ignored.cs"), ("q", "Program.cs")}


def test_a_large_folder_is_not_held(tmp_path):
    """Rows of a folder come as its entries are read, whatever their number; planning reads no file's state."""
    import tracemalloc

    from tallyforge.sources import tree

    for n in range(20_000):
        (tmp_path / f"f{n}.md").touch()
    (tmp_path / "in").mkdir()
    walk = tree.Walk("p", str(tmp_path), [], [], 1 << 20)
    tracemalloc.start()
    rows = sum(1 for _ in walk.below(""))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 20_000 and peak < 1 << 20
    assert walk.plan(64) == (["", "in"], [])

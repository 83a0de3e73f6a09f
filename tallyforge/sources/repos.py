"""Git histories, split inside a repository by ranges of commits of the first-parent line.

The log is streamed once and the commit noted at which each range begins, so a reader starts there and walks no other.
Ranges without a commit in the window are left out.  A range's commits are diffed through one ``diff-tree --stdin`` process.
The data sources take a range a partition and find them on the driver, which suits some repositories; ``read_history`` finds
them in tasks and deals them out to as many as the cluster has, which suits thousands.
"""

from __future__ import annotations

import subprocess
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package

COMMITS = 256
LOG = "project_id string, folder string, ord long, hash string, ts long, parent string, shallow boolean"
DIFF = "project_id string, hash string, output string"
# Options of git that make its output free of the user's settings.
PLAIN = ["--no-ext-diff", "--no-textconv", "--no-color", "--diff-algorithm=myers"]
#: What a diff can be asked for: line counts a file with renames, without, or the patch without context.
FORMS = {
    "renames": ["--numstat", "-z", "--find-renames=50%"],
    "plain": ["--numstat", "-z", "--no-renames"],
    "patch": ["--patch", "--unified=0", "--find-renames=50%"],
}
#: Two forms of one diff: line counts, an empty field, the patch.
COUNTS_AND_PATCH = ["--numstat", "-z", "--patch", "--unified=0", "--find-renames=50%"]
CHANGES = ["project_id", "hash", "renames", "plain", "patch"]
BLOCK = 1 << 20  # characters of diffs in a block, if a commit has no more
RANGE = "project_id string, folder string, begin string, ord long, count long, shallow boolean"
CHANGE = "project_id string, hash string, renames string, plain string, patch string"


def git(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], capture_output=True, check=True, timeout=600).stdout.decode("utf-8", "replace")


def log_lines(folder: str, begin: str, most: int | None = None) -> Iterator[tuple[str, int, str | None]]:
    """(hash, time, first parent) from a commit on, read as git writes them."""
    args = ["git", "-C", folder, "log", "--first-parent", "--format=%H %ct %P", *([f"--max-count={most}"] if most else []), begin]
    with subprocess.Popen(args, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) as process:
        for line in process.stdout:
            commit, ts, *parents = line.split()
            yield commit, int(ts), parents[0] if parents else None


class Range(InputPartition):
    def __init__(self, project: str = "", folder: str = "", begin: str = "", ord: int = 0, count: int = 0, shallow: bool = False):
        self.project, self.folder, self.begin, self.ord, self.count, self.shallow = project, folder, begin, ord, count, shallow

    def commits(self) -> Iterator[tuple[int, str, int, str | None]]:
        if self.count:
            for n, row in enumerate(log_lines(self.folder, self.begin, self.count)):
                yield self.ord + n, *row


def ranges(project: str, folder: str, since: int, until: int, size: int) -> Iterator[Range]:
    """The ranges of a repository that hold a commit of the window; none where there is no history."""
    try:
        head = git(folder, "rev-parse", "--verify", "HEAD").strip()
        shallow = git(folder, "rev-parse", "--is-shallow-repository").strip() == "true"
    except (subprocess.SubprocessError, OSError):
        return
    begin, count, used, ord_ = head, 0, False, 0
    for n, (commit, ts, _) in enumerate(log_lines(folder, head)):
        if count == size:
            if used:
                yield Range(project, folder, begin, ord_, count, shallow)
            begin, count, used, ord_ = commit, 0, False, n
        count, used = count + 1, used or since <= ts <= until
    if used:
        yield Range(project, folder, begin, ord_, count, shallow)


class DiffStream:
    """One process that diffs commit after commit."""

    def __init__(self, folder: str, form: str | list[str]):
        asked = FORMS[form] if isinstance(form, str) else form
        args = ["git", "-C", folder, "diff-tree", "--stdin", "-r", "--root", "--no-commit-id", *asked, *PLAIN]
        self.process = subprocess.Popen(args, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self.mark = f"end-{uuid.uuid4().hex}\n".encode()  # no object's name, so it is echoed

    def __enter__(self) -> DiffStream:
        return self

    def __exit__(self, *_) -> None:
        self.process.stdin.close()
        self.process.kill()
        self.process.wait()

    def of(self, commit: str, parent: str | None) -> str:
        """Against the parent; of a commit without one, all that it holds."""
        self.process.stdin.write(" ".join(filter(None, [commit, parent])).encode() + b"\n" + self.mark)
        self.process.stdin.flush()
        out = bytearray()
        while not out.endswith(self.mark):
            more = self.process.stdout.read1(1 << 20)
            if not more:
                raise RuntimeError(f"diff of {commit} broke off")
            out += more
        return out[: -len(self.mark)].decode("utf-8", "replace")


def net_ends(folder: str, since: int, until: int) -> tuple[str, str] | None:
    """The trees between which a window's net change lies: the newest commit before the window (nothing, if there is none and the history is whole) and its newest one."""
    shallow = git(folder, "rev-parse", "--is-shallow-repository").strip() == "true"
    after = before = None
    for commit, ts, _ in log_lines(folder, "HEAD"):
        if after is None and since <= ts <= until:
            after = commit
        if ts < since:
            before = commit
            break
    if after is None or (before is None and shallow):
        return None
    return before or git(folder, "hash-object", "-t", "tree", "/dev/null").strip(), after


def net_diff(project: str, folder: str, since: int, until: int, form: str) -> Iterator[tuple]:
    """One row under the newest commit of the window: the window's net change."""
    if ends := net_ends(folder, since, until):
        yield project, ends[1], git(folder, "diff", *FORMS[form], *PLAIN, *ends)


def forms_of(both: str, plain: Callable[[], str]) -> tuple[str, str, str]:
    """(renames, plain, patch): the diff without renames is made only where there are some, since nothing else needs it."""
    counts, end, patch = both.partition("\0\0")
    counts += end[:1]
    return counts, plain() if "\t\0" in counts else "", patch


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repos = [tuple(x.split("\t", 1)) for x in options.get("repos", "").split("\n") if x]
        self.since, self.until = int(options.get("since", 0)), int(options.get("until", 1 << 60))
        self.size, self.form, self.net = int(options.get("commits", COMMITS)), options.get("form", "renames"), options.get("net") == "true"

    def partitions(self):
        return [r for p, f in self.repos for r in ranges(p, f, self.since, self.until, self.size)] or [Range()]


class LogReader(_Reader):
    def read(self, partition: Range) -> Iterator[tuple]:
        for n, commit, ts, parent in partition.commits():
            yield partition.project, partition.folder, n, commit, ts, parent, partition.shallow


class DiffReader(_Reader):
    def partitions(self):
        if self.net:
            return [Range(p, f) for p, f in self.repos if next(ranges(p, f, self.since, self.until, 1 << 60), None)] or [Range()]
        return super().partitions()

    def read(self, partition: Range) -> Iterator[tuple]:
        if self.net:
            if partition.folder:
                yield from net_diff(partition.project, partition.folder, self.since, self.until, self.form)
            return
        if not partition.count:
            return
        with DiffStream(partition.folder, self.form) as stream:
            for _, commit, ts, parent in partition.commits():
                if self.since <= ts <= self.until and not (partition.shallow and parent is None):
                    yield partition.project, commit, stream.of(commit, parent)


class GitLog(DataSource):
    """Options: ``repos`` (lines of project TAB folder), ``commits`` a task."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)


class GitDiff(DataSource):
    """Options as of the log, and ``since``, ``until`` (epoch seconds), ``form`` (of FORMS), ``net`` (one change over the window)."""

    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return DIFF

    def reader(self, schema) -> DataSourceReader:
        return DiffReader(self.options)


def _load(spark: SparkSession, source: type[DataSource], repos: dict[str, str], **options) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(source)
    listed = "\n".join(f"{p}\t{f}" for p, f in repos.items())
    return spark.read.format(source.name()).options(repos=listed, **options).load()


def git_log(spark: SparkSession, repos: dict[str, str], commits: int = COMMITS) -> DataFrame:
    """The first-parent history of each repository; ``ord`` 0 is the newest commit."""
    return _load(spark, GitLog, repos, commits=commits)


def git_diff(spark: SparkSession, repos: dict[str, str], since: int = 0, until: int = 1 << 60, form: str = "renames", commits: int = COMMITS) -> DataFrame:
    """(project_id, hash, output): each commit of the window against its first parent."""
    return _load(spark, GitDiff, repos, since=since, until=until, form=form, commits=commits)


def git_net(spark: SparkSession, repos: dict[str, str], since: int, until: int, form: str = "renames") -> DataFrame:
    """(project_id, hash, output): one change over the window."""
    return _load(spark, GitDiff, repos, since=since, until=until, form=form, net="true")


def read_history(spark: SparkSession, repos: dict[str, str], since: int, until: int, net: bool = False, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The log of each repository, and (project_id, hash, renames, plain, patch): the window's commits against their first parents, or one net change a repository.

    Tasks find the ranges; ranges are dealt to tasks by number, whatever their repositories.  Each commit is diffed once: both results are kept, on disk
    where they have no room, until the caller unpersists them.
    """
    ship_package(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    size = size or COMMITS
    listed = spark.createDataFrame(list(repos.items()), "project_id string, folder string").repartition(max(1, min(tasks, len(repos))))

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, f in zip(frame["project_id"], frame["folder"]) for r in ranges(p, f, 0, 1 << 60, size)]
            yield pd.DataFrame([(r.project, r.folder, r.begin, r.ord, r.count, r.shallow) for r in rows], columns=["project_id", "folder", "begin", "ord", "count", "shallow"])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[Range]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield Range(row.project_id, row.folder, row.begin, int(row.ord), int(row.count), bool(row.shallow))

    def log(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in each(frames):
            yield pd.DataFrame([(r.project, r.folder, n, commit, ts, parent, r.shallow) for n, commit, ts, parent in r.commits()], columns=["project_id", "folder", "ord", "hash", "ts", "parent", "shallow"])

    def changed(r: Range, chosen: list[tuple[str, str | None]]) -> Iterator[tuple]:
        with DiffStream(r.folder, COUNTS_AND_PATCH) as both, DiffStream(r.folder, "plain") as plain:
            for commit, parent in chosen:
                yield r.project, commit, *forms_of(both.of(commit, parent), lambda: plain.of(commit, parent))

    def diffs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in each(frames):
            chosen = [(commit, parent) for _, commit, ts, parent in r.commits() if since <= ts <= until and not (r.shallow and parent is None)]
            held, rows = 0, []
            for row in changed(r, chosen) if chosen else ():
                rows.append(row)
                held += sum(map(len, row))
                if held > BLOCK:
                    yield pd.DataFrame(rows, columns=CHANGES)
                    held, rows = 0, []
            if rows:
                yield pd.DataFrame(rows, columns=CHANGES)

    def nets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in each(frames):
            if r.ord == 0 and (ends := net_ends(r.folder, since, until)):
                ask = lambda form, ends=ends, r=r: git(r.folder, "diff", *form, *PLAIN, *ends)
                yield pd.DataFrame([(r.project, ends[1], *forms_of(ask(COUNTS_AND_PATCH), lambda: ask(FORMS["plain"])))], columns=CHANGES)

    dealt = listed.mapInPandas(found, RANGE).repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    commits = dealt.mapInPandas(log, LOG).persist(StorageLevel.MEMORY_AND_DISK)
    return commits, dealt.mapInPandas(nets if net else diffs, CHANGE).persist(StorageLevel.MEMORY_AND_DISK)

"""Source trees in two phases: a listing of what counts, without contents, and the contents of the files chosen.

The walk knows the ignore rules (the configured ones, each ignore file it passes and a project's own), so ignored folders
and nested repositories are never entered.  The driver opens folders breadth first only until there are enough of them
for the tasks; each of those is a task's walk.  Contents are read where Spark has dealt the chosen paths, file by file.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions import dims
from ..operators.paths import parse_rules
from ..session import ship_package

LISTING = "project_id string, path string, state string, size long, modified long"
IGNORE_FILE = ".gitignore"
SPREAD = 64  # folders that a root is dealt out to, if it has as many
BATCH_BYTES = 8 << 20
Rule = tuple[re.Pattern, bool, bool]


def compiled(lines: list[str], base: str = "") -> list[Rule]:
    return [(re.compile(regex), negated, folders) for regex, negated, folders in parse_rules(lines, base)]


def is_ignored(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """The last rule that matches decides."""
    inner = is_dir or "/" in path
    for regex, negated, folders in reversed(rules):
        if (inner or not folders) and regex.search(path):
            return not negated
    return False


class Walk:
    """One root's rules and what the walk tells of its folders."""

    def __init__(self, project: str, root: str, excludes: list[str], own: list[str], max_bytes: int):
        self.project, self.root, self.max_bytes = project, root, max_bytes
        self.general, self.own = compiled(excludes), compiled(own)

    def rules_in(self, folder: str, above: list[Rule]) -> list[Rule]:
        """Rules of ignore files that hold in a folder: those from above, then its own file's."""
        try:
            name = os.path.join(self.root, folder, IGNORE_FILE)
            if os.path.islink(name) or os.path.getsize(name) > self.max_bytes:
                return above
            with open(name, encoding="utf-8") as f:
                return above + compiled(f.read().splitlines(), folder)
        except (OSError, UnicodeDecodeError):
            return above

    def rules_down_to(self, folder: str) -> list[Rule]:
        """Rules of the ignore files above ``folder``, from the root on."""
        found, parts = [], folder.split("/") if folder else []
        for k in range(len(parts)):
            found = self.rules_in("/".join(parts[:k]), found)
        return found

    def entries(self, folder: str, files: list[Rule], enter: list[str], told: bool = True) -> Iterator[tuple]:
        """Rows of a folder's entries (none, unless ``told``) as they are read: none is held, however many there are.  Folders to enter next go to ``enter``."""
        rules = [*self.general, *files, *self.own]
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                for e in found:
                    path = f"{folder}/{e.name}" if folder else e.name
                    try:
                        inner = e.is_dir(follow_symlinks=False)
                        if e.is_symlink() or not (told or inner) or is_ignored(path, inner, rules):
                            continue
                        if not inner:
                            info = e.stat()
                            yield self.project, path, "file", info.st_size, int(info.st_mtime * 1000)
                        elif not os.path.lexists(os.path.join(e.path, ".git")):
                            enter.append(path)
                        elif told:
                            yield self.project, path, "repository", 0, 0
                    except OSError:
                        if told:
                            yield self.project, path, "unlisted", 0, 0
        except OSError:
            if told:
                yield self.project, folder, "unlisted", 0, 0

    def below(self, start: str) -> Iterator[tuple]:
        todo = [(start, self.rules_down_to(start))]
        while todo:
            folder, above = todo.pop()
            rules, enter = self.rules_in(folder, above), []
            yield from self.entries(folder, rules, enter)
            todo += [(path, rules) for path in sorted(enter)]

    def plan(self, spread: int) -> tuple[list[str], list[str]]:
        """Folders to tell without those in them, and folders to walk whole; at most about ``spread`` are opened for it, their files unread."""
        flat, todo = [], deque([("", [])])
        while todo and len(todo) < spread and len(flat) < 4 * spread:
            folder, above = todo.popleft()
            flat.append(folder)
            rules, enter = self.rules_in(folder, above), []
            for _ in self.entries(folder, rules, enter, told=False):
                pass
            todo.extend((path, rules) for path in sorted(enter))
        return flat, [folder for folder, _ in todo]


class Folders(InputPartition):
    def __init__(self, project: str, flat: list[str], whole: str | None):
        self.project, self.flat, self.whole = project, flat, whole


class ListingReader(DataSourceReader):
    """Filters on project_id leave out other roots before anything is opened."""

    def __init__(self, roots: dict[str, str], excludes: list[str], own: dict[str, list[str]], max_bytes: int, spread: int):
        self.walks = {p: Walk(p, root, excludes, own.get(p, []), max_bytes) for p, root in roots.items()}
        self.spread = spread

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("project_id",):
                self.walks = {p: w for p, w in self.walks.items() if p == f.value}
            elif isinstance(f, In) and f.attribute == ("project_id",):
                self.walks = {p: w for p, w in self.walks.items() if p in f.value}
            else:
                yield f

    def partitions(self):
        parts = []
        for project, walk in self.walks.items():
            flat, whole = walk.plan(self.spread) if os.path.isdir(walk.root) else ([], [])
            parts += [Folders(project, flat, None), *(Folders(project, [], w) for w in whole)]
        return parts or [Folders("", [], None)]

    def read(self, partition) -> Iterator[tuple]:
        walk = self.walks.get(partition.project)
        if walk is None:
            return
        if partition.whole is not None:
            yield from walk.below(partition.whole)
        elif not os.path.isdir(walk.root):
            yield partition.project, "", "absent", 0, 0
        for folder in partition.flat:
            yield from walk.entries(folder, walk.rules_in(folder, walk.rules_down_to(folder)), [])


class SourceListing(DataSource):
    """Options, as JSON: ``roots``, ``own`` (project to folder, to patterns), ``excludes`` (patterns); ``max_bytes`` of an ignore file."""

    @classmethod
    def name(cls) -> str:
        return "source_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        read = lambda key: json.loads(o.get(key) or "{}")
        return ListingReader(read("roots"), read("excludes") or [], read("own"), int(o.get("max_bytes", dims.MAX_FILE_BYTES)), int(o.get("spread", SPREAD)))


def listing(spark: SparkSession, roots: dict[str, str], excludes: list[str], own: dict[str, list[str]] | None = None, max_bytes: int = dims.MAX_FILE_BYTES, spread: int = SPREAD) -> DataFrame:
    """(project_id, path, state, size, modified): ``file``, ``repository`` (nested, not entered), ``unlisted`` (cannot be opened), ``absent`` (no such root)."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceListing)
    options = {"roots": json.dumps(roots), "excludes": json.dumps(list(excludes)), "own": json.dumps(own or {}), "max_bytes": max_bytes, "spread": spread}
    return spark.read.format("source_listing").options(**options).load()


def with_contents(files: DataFrame, roots: dict[str, str], max_bytes: int) -> DataFrame:
    """``files`` (project_id, path, size and more) with ``content``, null for files over ``max_bytes`` or that cannot be read.

    Paths are dealt by hash, so a folder of many files is many tasks' work.  A batch holds BATCH_BYTES or one file.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def content(project: str, path: str, size: int) -> bytes | None:
        if size > max_bytes:
            return None
        try:
            with open(os.path.join(roots[project], path), "rb") as f:
                return f.read()
        except OSError:
            return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, data = 0, 0, []
            keys = zip(*(batch[c].to_pylist() for c in ("project_id", "path", "size")), strict=True)
            for n, key in enumerate(keys, 1):
                data.append(content(*key))
                held += len(data[-1] or b"")
                if held >= BATCH_BYTES or n == batch.num_rows:
                    part = batch.slice(begin, n - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*part.schema.names, "content"])
                    begin, held, data = n, 0, []

    schema = files.withColumn("content", F.lit(None).cast("binary")).schema
    return files.repartition(tasks, "project_id", "path").mapInArrow(read, schema)

"""Python data sources: files of trees with their contents (names that begin with a point too) and SQLite tables.

They read what a folder on each executor's machine or a shared mount holds.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package

TREE = "project_id string, path string, is_dir boolean, size long, modified long, content binary"


class Part(InputPartition):
    def __init__(self, *value):
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, parts: list[tuple], read):
        self.parts, self.read_one = parts, read

    def partitions(self):
        return [Part(*p) for p in self.parts] or [Part()]

    def read(self, partition) -> Iterator[tuple]:
        if partition.value:
            yield from self.read_one(*partition.value)


def walk(project: str, root: str, max_bytes: int, pattern: str, prune: str, start: str = "", deep: bool = True) -> Iterator[tuple]:
    """Entries below a folder of a root, or only those in it; links are skipped, unreadable folders too, and folders that match
    ``prune`` are not entered."""
    todo, name_ok, shut = [start], re.compile(pattern), re.compile(prune) if prune else None
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_symlink():
                    continue
                info = e.stat()
                if e.is_dir():
                    if deep and not (shut and shut.search(path)):
                        todo.append(path)
                    yield project, path, True, 0, int(info.st_mtime * 1000), None
                elif name_ok.search(e.name):
                    data = None
                    if info.st_size <= max_bytes:
                        with open(os.path.join(root, path), "rb") as f:
                            data = f.read()
                    yield project, path, False, info.st_size, int(info.st_mtime * 1000), data
            except OSError:
                continue


SPREAD = 64  # tasks for the folders of a root


def walks(project: str, root: str, max_bytes: int, pattern: str, prune: str, starts: list[str], deep: bool) -> Iterator[tuple]:
    for start in starts:
        yield from walk(project, root, max_bytes, pattern, prune, start, deep)


class SourceTree(DataSource):
    """Options: ``roots`` (lines of project TAB folder), ``max_bytes`` (larger files come without content), ``names``, ``prune`` (regex)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        most, names, prune = int(o.get("max_bytes", 5 << 20)), o.get("names", "."), o.get("prune", "")
        roots = [line.split("\t", 1) for line in o.get("roots", "").split("\n") if line]
        parts = []  # a task for what stands in a root, and at most SPREAD for the folders there
        for project, root in roots:
            tops = [path for _, path, is_dir, *_ in walk(project, root, -1, "^$", "", deep=False) if is_dir and not (prune and re.search(prune, path))]
            parts.append((project, root, most, names, prune, [""], False))
            parts += [(project, root, most, names, prune, tops[k::SPREAD], True) for k in range(min(SPREAD, len(tops)))]
        return _Reader(parts, walks)


ROWS = 100_000  # of a table in one task


def _not_held(status: int, *_) -> None:
    if status in (5, 6):  # busy, locked: backup would try for ever
        raise sqlite3.OperationalError("held by a writer")


def snapshot(path: str, folder: str) -> str:
    """A copy of a database as of one moment, what its log holds included; a locked one is copied with its log.

    All tables of a database that has not changed meanwhile are read from the same copy.
    """
    stats = [os.stat(path + end) for end in ("", "-wal") if os.path.exists(path + end)]
    state = [path, *((x.st_size, x.st_mtime_ns, x.st_ino) for x in stats)]
    to = os.path.join(folder, hashlib.sha256(repr(state).encode()).hexdigest()[:32] + ".db")
    if os.path.exists(to):
        return to
    new = f"{to}-{uuid.uuid4().hex}"
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        try:
            with closing(sqlite3.connect(new)) as copy:
                db.backup(copy, progress=_not_held)
        except sqlite3.OperationalError:  # held by a writer
            for end in ("", "-wal", "-shm"):
                if os.path.exists(path + end):
                    shutil.copy(path + end, new + end)
            with closing(sqlite3.connect(new)) as copy:  # what its log holds goes into the copy
                copy.execute("pragma journal_mode = delete")
    os.replace(new, to)
    return to


def columns_of(db: sqlite3.Connection, table: str) -> list[str]:
    return [r[1] for r in db.execute(f"pragma table_info({quoted(table)})")]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def row_ranges(file: str, table: str, rows: int) -> list[tuple[int | None, int | None]]:
    """Ranges of rowids, ``rows`` each, of a table; one open range of a view or a table without rowids; none without the table."""
    with closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True)) as db:
        if not columns_of(db, table):
            return []
        try:
            every = f"select rowid from (select rowid, row_number() over (order by rowid) as n from {quoted(table)}) where (n - 1) % ? = 0"
            starts = [r[0] for r in db.execute(every, (rows,))]
        except sqlite3.OperationalError:
            return [(None, None)]
        return list(zip(starts, [*starts[1:], None])) if all(isinstance(x, int) for x in starts) else [(None, None)]


def read_sqlite(path: str, file: str, table: str, columns: list[str], low: int | None, high: int | None) -> Iterator[tuple]:
    """Rows of a range as they come, with the number of each: its rowid, or its place where there is none."""
    with closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True)) as db:
        there = set(columns_of(db, table))
        picked = ", ".join(quoted(c) if c in there else "null" for c in columns) or "null"
        if low is None:
            found = enumerate(db.execute(f"select {picked} from {quoted(table)}"))
        else:
            until, bounds = (" and rowid < ?", (low, high)) if high is not None else ("", (low,))
            found = ((r[0], r[1:]) for r in db.execute(f"select rowid, {picked} from {quoted(table)} where rowid >= ?{until} order by rowid", bounds))
        for n, row in found:
            yield (path, n, *row[: len(columns)])


class SqliteTable(DataSource):
    """Options: ``paths`` (lines), ``table``, ``copies`` (a folder that all tasks see, for copies of the databases), ``rows`` a task;
    the columns come from the schema, after ``path string, row long``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return "path string, row long"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        table, fields = o["table"], [(f.name, f.dataType.simpleString()) for f in schema.fields[2:]]
        kinds = {"string": _text, "double": _number, "binary": _bytes}

        def read(path: str, file: str, low: int | None, high: int | None) -> Iterator[tuple]:
            for file_, n, *row in read_sqlite(path, file, table, [c for c, _ in fields], low, high):
                yield (file_, n, *[kinds[kind](x) for (_, kind), x in zip(fields, row)])

        parts = []
        for path in (p for p in o.get("paths", "").split("\n") if p and os.path.exists(p)):
            file = snapshot(path, o["copies"])
            parts += [(path, file, low, high) for low, high in row_ranges(file, table, int(o.get("rows", ROWS)))]
        return _Reader(parts, read)


def _text(x):
    return x if x is None or isinstance(x, str) else ",".join(map(str, x)) if isinstance(x, bytes) else format(x, "g") if isinstance(x, float) and x == int(x) else str(x)


def _number(x):
    try:
        return None if x is None else float(x)
    except (TypeError, ValueError):
        return 0.0


def _bytes(x):
    return x.encode() if isinstance(x, str) else x


def register(spark: SparkSession) -> None:
    ship_package(spark)
    for source in (SourceTree, SqliteTable):
        spark.dataSource.register(source)


def source_tree(spark: SparkSession, roots: dict[str, str], max_bytes: int = 5 << 20, names: str = ".", prune: str = "") -> DataFrame:
    register(spark)
    listed = "\n".join(f"{p}\t{r}" for p, r in roots.items())
    return spark.read.format("source_tree").options(roots=listed, max_bytes=max_bytes, names=names, prune=prune).load()


_FOLDERS: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A folder of this application that driver and tasks see: below ``spark.checkpoint.dir``, in a local session without it a temporary one.  It goes at the driver's end."""
    app = spark.sparkContext.applicationId, label
    if app in _FOLDERS:
        return _FOLDERS[app]
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix=f"tallyforge-{label}-")
    elif shared is None or (urlparse(shared).scheme or "file") != "file":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors mount")
    else:
        folder = os.path.join(urlparse(shared).path, f"{label}-{uuid.uuid4().hex}")
        os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _FOLDERS[app] = folder
    return folder


def sqlite_table(spark: SparkSession, paths: list[str], table: str, columns: str, rows: int = ROWS) -> DataFrame:
    """(path, row, columns) of a table of some databases, ``rows`` a task, all of a database as of one moment."""
    register(spark)
    options = {"paths": "\n".join(paths), "table": table, "copies": shared_folder(spark, "sqlite"), "rows": rows}
    return spark.read.format("sqlite_table").schema(f"path string, row long, {columns}").options(**options).load()


def in_order(files: DataFrame) -> DataFrame:
    """``files`` with ``file_ord``, which grows with the sorted paths: a range (9 bits) and a place there (22).

    Names are range-sorted without the other columns.
    """
    parts = min(512, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = files.select("project_id", "path").repartitionByRange(parts, "project_id", "path").sortWithinPartitions("project_id", "path")
    place = F.monotonically_increasing_id()  # the range from bit 33 on, the place below
    order = order.withColumn("file_ord", F.shiftleft(F.shiftright(place, 33), 22) + place.bitwiseAND(F.lit((1 << 22) - 1)))
    return files.join(order, ["project_id", "path"])


def numbered_lines(files: DataFrame, pattern: str) -> DataFrame:
    """(path, ord, line) of the text files whose names match: ord is the file's place (31 bits), then the line (26)."""
    text = F.col("content").cast("string")
    rows = files.where(F.regexp_like("path", F.lit(pattern)) & F.col("content").isNotNull())
    rows = rows if "file_ord" in files.columns else in_order(rows)
    lines = rows.select("project_id", "path", "file_ord", F.posexplode(F.split(text, r"\r\n|\r|\n", -1)).alias("n", "line"))
    return lines.select("project_id", "path", (F.shiftleft(F.col("file_ord"), 26) + F.col("n")).alias("ord"), "line")

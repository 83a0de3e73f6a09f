"""Records of agents' logs that are kept between loads, and the state that lets the next load read only what is new.

Two kinds of source:
  lines       files that grow by lines.  What is kept of a file is how far it was read (after its last line end), how many lines that
              were, a mark of the bytes before, and the lines that later ones depend on.  A file that begins as it did is read from
              there on; its older records stay.
  documents   files and databases that are written anew.  One that has another size or time than before (a database with its log,
              a document with what it refers to) is read again whole, the others not at all.

A folder that driver and executors share holds ``records`` (a part a load), one list of files and one of carried lines for each load and
a document that names the lists in force.  The document is replaced last, so a load that dies leaves the state before it.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files as raw
from . import sinks

VERSION = "2"
TASK_BYTES = 64 << 20
LINE_BITS = 26
MOST_PARTS = 32  # beyond, the records that count are written together
LINE_END = re.compile(rb"\r\n|\r|\n")
UNIT = "path string, file_ord long, length long, modified long"
#: A file may stand in several parts: its records there are those of lines or entries from ``first`` up to ``last``.
KNOWN = f"{UNIT}, version string, part string, first long, last long, offset long, n_lines long, mark string"
CARRY = "path string, n long, line string"
READ = "path string, offset long, n_lines long, mark string, first long, bytes long, lines array<string>"
ENDLESS = 1 << 62


def listing(spark: SparkSession, folders: list[str], names: str) -> DataFrame:
    """(path, file_ord, length, modified) of the files below the folders, in order of folder and path; no contents are read."""
    roots = {f"{i:04d}": folder for i, folder in enumerate(folders)}
    found = raw.source_tree(spark, roots, max_bytes=-1, names=names).where("not is_dir").select("project_id", "path", F.col("size").alias("length"), "modified")
    named = F.create_map(*[F.lit(x) for pair in roots.items() for x in pair])
    full = F.concat(named[F.col("project_id")], F.lit("/"), "path")
    return raw.in_order(found).select(full.alias("path"), "file_ord", "length", "modified")


def marked(file, offset: int) -> str:
    """What the bytes before an offset are known by: the first and the last of them."""
    file.seek(0)
    head = file.read(min(offset, 4096))
    file.seek(max(0, offset - 4096))
    return hashlib.sha256(head + file.read(min(offset, 4096))).hexdigest()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, offset, n_lines, mark in zip(batch["path"], batch["offset"], batch["n_lines"], batch["mark"]):
            try:
                with open(path, "rb") as f:
                    if not offset or f.seek(0, 2) < offset or marked(f, offset) != mark:
                        offset = n_lines = 0
                    f.seek(offset)
                    data = f.read()
                    whole = data.rfind(b"\n") + 1
                    done, n = offset + whole, n_lines + len(LINE_END.findall(data[:whole]))
                    row = (path, done, n, marked(f, done), n_lines, len(data), re.split(r"\r\n|\r|\n", data.decode("utf-8", "replace")))
            except OSError:  # counts as empty until its size or time changes
                row = (path, 0, 0, "", 0, 0, [])
            yield pd.DataFrame([row], columns=["path", "offset", "n_lines", "mark", "first", "bytes", "lines"])


class Cache:
    """The state of one source's cache; one load at a time may write it."""

    def __init__(self, spark: SparkSession, folder: str, bits: int | None, rescan: bool):
        os.makedirs(folder, exist_ok=True)
        self.spark, self.folder, self.bits, self.this = spark, folder, bits, uuid.uuid4().hex
        self.document = os.path.join(folder, "state.json")
        state = sinks.read_document(self.document, {})
        old = state.get("files") if state.get("version") == VERSION and not rescan else None
        self.known = self._table("files", old, KNOWN)
        self.carried = self._table("carry", old, CARRY)

    def _at(self, kind: str, key: str) -> str:
        return os.path.join(self.folder, f"{kind}-{key}")

    def _table(self, kind: str, key: str | None, schema: str) -> DataFrame:
        path = self._at(kind, key) if key else None
        return self.spark.read.schema(schema).parquet(path) if path and os.path.isdir(path) else self.spark.createDataFrame([], schema)

    def kept(self, df: DataFrame, kind: str) -> DataFrame:
        df.write.parquet(self._at(kind, self.this))
        return self.spark.read.schema(df.schema).parquet(self._at(kind, self.this))

    def split(self, now: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(changed, same) units of ``now``."""
        keys = ["path", "length", "modified"]
        known = self.known.select(*keys).distinct()
        return now.join(known, keys, "left_anti"), now.join(known, keys, "left_semi")

    def write(self, fresh: DataFrame, owner: DataFrame) -> None:
        """The load's part of the records: their place in their own file instead of ``ord``, and the file by its path."""
        rows = fresh.drop("path")
        if self.bits is None:  # one unit, all records are its own
            rows = rows.withColumnRenamed("ord", "line_no").withColumn("path", F.lit(owner.first()[0]) if not owner.isEmpty() else F.lit(""))
        else:
            line = F.col("ord").bitwiseAND(F.lit((1 << self.bits) - 1))
            rows = rows.withColumns({"file_ord": F.shiftright("ord", self.bits), "line_no": line}).drop("ord")
            rows = rows.join(owner.select("path", "file_ord"), "file_ord").drop("file_ord")
        self.columns = [c for c in rows.columns if c not in ("path", "line_no")]
        self.schema = rows.schema.add("part", "string")
        rows.write.parquet(os.path.join(self.folder, "records", f"part={self.this}"))

    def records(self, files: DataFrame) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(os.path.join(self.folder, "records"))
        out = rows.join(files.select("path", "part", "file_ord", "first", "last"), ["path", "part"]).where("line_no >= first and line_no < last")
        return out.select(*self.columns, "path", "file_ord", "line_no")

    def commit(self, segments: DataFrame, now: DataFrame, carry: DataFrame | None) -> tuple[DataFrame, dict[str, int]]:
        """The records of all files, and how many files were read and not."""
        files = self.kept(segments.drop("file_ord").join(now.select("path", "file_ord"), "path").select(*[c.split()[0] for c in KNOWN.split(", ")]), "files")
        if carry is not None:
            self.kept(carry, "carry")
        counts = {r.fresh: r.n for r in files.groupBy("path").agg(F.max(F.col("part") == self.this).alias("fresh")).groupBy("fresh").agg(F.count(F.lit(1)).alias("n")).collect()}
        used = {r.part for r in files.select("part").distinct().collect()}  # a name a load that still counts
        if len(used) > MOST_PARTS:
            self.this, state = uuid.uuid4().hex, self.this
            self.records(files).drop("file_ord").write.parquet(os.path.join(self.folder, "records", f"part={self.this}"))
            one = files.groupBy("path").agg(F.max_by(F.struct(*[c for c in files.columns if c not in ("path", "part", "first", "last")]), "last").alias("f"))
            files = self.kept(one.select("path", "f.*", F.lit(self.this).alias("part"), F.lit(-ENDLESS).alias("first"), F.lit(ENDLESS).alias("last")).select(*files.columns), "files")
            if carry is not None:
                os.rename(self._at("carry", state), self._at("carry", self.this))
            used = {self.this}
        sinks.write_document({"version": VERSION, "files": self.this}, self.document)
        for name in os.listdir(self.folder):  # lists before this one, and lists of loads that died
            if "-" in name and not name.endswith(self.this):
                shutil.rmtree(os.path.join(self.folder, name), ignore_errors=True)
        for name in os.listdir(os.path.join(self.folder, "records")):
            if name.startswith("part=") and name[5:] not in used | {self.this}:
                shutil.rmtree(os.path.join(self.folder, "records", name), ignore_errors=True)
        order = (F.col("line_no") if self.bits is None else F.shiftleft("file_ord", self.bits) + F.col("line_no")).alias("ord")
        return self.records(files).select(*self.columns, order), {"read": counts.get(True, 0), "reused": counts.get(False, 0)}


def load(
    spark: SparkSession, folders: list[str], names: str, parse: Callable[[DataFrame], DataFrame], cache: str, rescan: bool = False, carry: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """(``parse`` of all files' lines, counts of files read and reused) for files that grow by lines.

    ``parse``: from (path, ord, line) to records with the ``ord`` of their line; a file's records depend on that file alone, and on earlier lines
    only by those that ``carry`` picks.  A line that has no end yet is read again.  Order is that of the files there are now.
    """
    at = Cache(spark, cache, LINE_BITS, rescan)
    now = at.kept(listing(spark, folders, names), "listing")
    changed, same = at.split(now)
    newest = at.known.groupBy("path").agg(F.max_by(F.struct("offset", "n_lines", "mark"), "last").alias("k"))
    todo = changed.join(newest, "path", "left").select("path", "file_ord", "length", "modified", *[F.coalesce(f"k.{c}", F.lit(0)).cast("long").alias(c) for c in ("offset", "n_lines")], F.coalesce("k.mark", F.lit("")).alias("mark"))
    total = todo.agg(F.sum(F.greatest(F.lit(0), F.col("length") - F.col("offset")))).first()[0] or 0
    got = at.kept(todo.repartition(min(100_000, total // TASK_BYTES + 1)).mapInPandas(_read, READ), "read")
    heads = got.drop("lines")
    grown = heads.where("first > 0")
    lines = got.join(changed.select("path", "file_ord"), "path").select("path", "file_ord", "first", F.posexplode("lines").alias("k", "line")).select("path", "file_ord", (F.col("first") + F.col("k")).alias("n"), "line")
    old = at.carried.join(grown.select("path"), "path", "left_semi").join(changed.select("path", "file_ord"), "path").select("path", "file_ord", "n", "line")
    every = lines.unionByName(old).select("path", (F.shiftleft("file_ord", LINE_BITS) + F.col("n")).alias("ord"), "line")
    every = at.kept(every, "lines")  # parsed twice: for records and for what is carried
    at.write(parse(every), changed)
    own = changed.join(heads, "path").withColumns({"part": F.lit(at.this), "last": F.lit(ENDLESS), "version": F.lit(VERSION)}).drop("bytes")
    before = at.known.join(grown.select("path", F.col("first").alias("upto")), "path").withColumn("last", F.least("last", "upto")).where("first < last").drop("upto")
    before = before.drop("file_ord", "length", "modified", "offset", "n_lines", "mark").join(own.drop("part", "first", "last", "version"), "path")
    stay = at.known.join(same.select("path"), "path", "left_semi")
    segments = reduce(DataFrame.unionByName, [own, before.select(*own.columns), stay.select(*own.columns)])
    kept = None
    if carry is not None:
        picked = carry(every).select("path", F.col("ord").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).alias("n"), "line")
        # A line without its end is no state yet.
        picked = picked.join(heads.select("path", "n_lines"), "path").where("n < n_lines").drop("n_lines")
        kept = picked.unionByName(at.carried.join(same.select("path"), "path", "left_semi"))
    return at.commit(segments, now, kept)


def load_documents(
    spark: SparkSession, units: DataFrame, parse: Callable[[DataFrame], DataFrame], cache: str, bits: int | None, rescan: bool = False
) -> tuple[DataFrame, dict[str, int]]:
    """(``parse`` of all units, counts of units read and reused).

    ``units``: (path, file_ord, length, modified); ``parse``: from such rows to records with an ``ord`` of file_ord (shifted by ``bits``) and place.
    Without ``bits`` there is one unit, and ``ord`` is the place in it.
    """
    at = Cache(spark, cache, bits, rescan)
    now = at.kept(units.select("path", "file_ord", F.col("length").cast("long").alias("length"), F.col("modified").cast("long").alias("modified")), "listing")
    changed, same = at.split(now)
    fresh = parse(changed)
    at.write(fresh.limit(0) if changed.isEmpty() else fresh, changed)
    nothing = {"offset": F.lit(0).cast("long"), "n_lines": F.lit(0).cast("long"), "mark": F.lit("")}
    own = changed.withColumns({"part": F.lit(at.this), "first": F.lit(-ENDLESS), "last": F.lit(ENDLESS), "version": F.lit(VERSION)} | nothing)
    stay = at.known.join(same.select("path"), "path", "left_semi")
    return at.commit(own.unionByName(stay.select(*own.columns)), now, None)

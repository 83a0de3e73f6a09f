"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

The index is a set of runs.  A run is a table (h, keep): the hash of a line and the document that keeps it, dealt to
buckets by hash and sorted by it within each.  Documents come in batches, in order of their identifiers.  A batch's
distinct hashes are dealt and sorted once and merge-joined with every run: a run is read bucket by bucket in its own
order, without a shuffle or a sort.  Hashes that no run holds, the anti-join, are the batch's own run.  When a level
holds two runs they are merged into one of the next level, so there are about log2(batches) runs to join and a hash is
written about as often.

A line of a batch goes if an older run holds its hash or if a smaller identifier of the batch has it.  Hashes of more
than a thousandth of the batch's lines meet their lines by broadcast (at most a thousand such hashes), so a line that
every document repeats stays where it is.

Hashes are the first 128 bits of SHA-256 of the key: the line with white space stripped at both ends and A-Z
lower-cased.  A text is known by its identifier and 128 bits of it.

Defined cases: null or empty text is one empty line; rows with the same identifier are one document; rows without an
identifier are one document, after all others; repeated rows are cut alike; an empty table gives an empty result; other
columns are not looked at; a text's lines are held in one row, so memory is in proportion to the longest text.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _MADE, cut, discard, drop_shuffles, join_hot, let, ready, scratch_dir
from .exact_dedup import LOWER, UPPER, ascii_lower

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
BATCHES = 6


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """A hash for each line, null for lines whose key is shorter than ``min_chars``."""

    def hashed(key: Column) -> Column:
        return F.when(F.char_length(key) >= min_chars, F.unhex(F.substring(F.sha2(key, 256), 1, 32)))

    return F.transform(lines_of(ascii_lower(text)), lambda line: let(F.btrim(line, F.lit(SPACE)), hashed))


@contextlib.contextmanager
def sorted_reads(spark: SparkSession) -> Iterator[None]:
    """Plans made in this block take a bucket of a single file as sorted, as it was written."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The runs of all batches so far."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, df: DataFrame) -> DataFrame:
        name = f"tallyforge_run_{uuid.uuid4().hex}"
        path = f"{scratch_dir(self.spark)}/{name}"
        df.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).format("parquet").saveAsTable(name)
        _MADE.add(path)
        out = self.spark.table(name)
        out._scratch_path, out._table = path, name
        return out

    def _drop(self, table: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table._table}")
        discard(table)

    def add(self, lines: DataFrame) -> tuple[DataFrame, int]:
        """Take the next batch, ``lines`` (doc, h) of documents after all earlier ones.

        Returns (h, keep, n), how many of the batch's lines have h, of hashes that some of its documents lose because ``keep`` has them, and the
        number of the batch's lines.
        """
        marked = lines.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n"))
        held = F.lit(None)
        for k, run in enumerate(self.runs()):
            marked = marked.join(run.select("h", F.col("keep").alias(f"k{k}")).hint("merge"), "h", "left")
            held = F.coalesce(held, F.col(f"k{k}"))
        marked = marked.select("h", F.coalesce(held, "low").alias("keep"), held.isNull().alias("new"), "high", "n")
        with sorted_reads(self.spark):
            marked = self._write(marked)
            self._put(0, self._write(marked.where("new").select("h", "keep")))
        lost = cut(marked.where("high > keep").select("h", "keep", "n"), "line-lost")
        total = marked.agg(F.sum("n")).first()[0] or 0
        self._drop(marked)
        return lost, total

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        if not self.levels[level]:
            self.levels[level].append(run)
            return
        other = self.levels[level].pop()  # the two have no hash in common: a full outer merge join is their merge
        a, b = (x.select("h", "keep") for x in (other, run))
        both = a.hint("merge").join(b, a["h"] == b["h"], "full_outer")
        merged = self._write(both.select(F.coalesce(a["h"], b["h"]).alias("h"), F.coalesce(a["keep"], b["keep"]).alias("keep")))
        self._drop(other)
        self._drop(run)
        self._put(level + 1, merged)

    def drop(self) -> None:
        for run in self.runs():
            self._drop(run)
        self.levels = []


def batch_ends(df: DataFrame, column: str, batches: int) -> list:
    """First values of all batches but the first, nearly even, from the ranges that Spark samples."""
    own = df.select(column).where(F.col(column).isNotNull()).repartitionByRange(batches, column)
    ends = sorted(r[1] for r in own.groupBy(F.spark_partition_id()).agg(F.min(column)).collect())
    return ends[:: -(-len(ends) // batches) or 1][1:]


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text), a row for each row of ``df``."""
    spark = ready(df).sparkSession
    text = F.col(text_col)
    row = [F.col(id_col).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]
    docs = df.select(*row, text.alias("text"))
    batch = F.lit(0)
    for k, end in enumerate(batch_ends(df.select(F.col(id_col).alias("id")), "id", batches)):
        batch = F.when(F.col("id") >= F.lit(end), k + 1).otherwise(batch)
    batch = F.when(F.col("id").isNull(), batches).otherwise(batch)
    hashed = cut(docs.select("id", "a", "b", line_hashes(F.col("text"), min_chars).alias("hashes"), batch.alias("batch")), "line-hashes", "batch")
    index, gone = LineRuns(spark), []
    for k in sorted(r[0] for r in hashed.select("batch").distinct().collect()):  # at most batches + 1
        lines = hashed.where(F.col("batch") == k).select(F.struct(F.col("id").isNull().alias("none"), "id").alias("doc"), "a", "b", F.posexplode("hashes").alias("pos", "h")).where("h IS NOT NULL")
        lost, total = index.add(lines.select("doc", "h"))
        hit = join_hot(lines, lost, ["h"], total).where(F.col("doc") > F.col("keep"))
        gone.append(cut(hit.select("doc.id", "a", "b", "pos"), "line-gone"))
        discard(lost)
    index.drop()
    discard(hashed)
    places = reduce(DataFrame.unionByName, gone, docs.select("id", "a", "b", F.lit(0).alias("pos")).limit(0))
    places = cut(places.groupBy("id", "a", "b").agg(F.collect_set("pos").alias("gone")), "line-places")
    discard(*gone)
    drop_shuffles(spark)
    same = F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.a") == F.col("g.a")) & (F.col("d.b") == F.col("g.b"))
    met = docs.alias("d").join(places.alias("g"), same, "left").select("d.id", "text", "gone")

    def kept(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.array_join(F.transform(stay, lambda i: x["lines"][i]), "\n")

    return met.select(
        "id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(let(F.struct(lines_of(F.col("text")).alias("lines"), "gone"), kept))
        .alias("kept_text"),
    )


def line_digests(df: DataFrame, **how) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), a row for each row of ``df``."""
    found = dedup_lines(df, **how)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS low FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, line, pos, low IS NOT NULL AND doc_id > low AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

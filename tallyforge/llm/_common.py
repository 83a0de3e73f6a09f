"""Shared helpers of the training-data operators: tables, scratch storage, native span finding."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

_OWN: dict[str, str] = {}
_MADE: set[str] = set()
_collected = 0.0
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(df: DataFrame) -> DataFrame:
    """``df`` in a session whose Python workers find this package and get batches of bounded size; first in each operator."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    return df


def set_apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with names that no operator uses, and the given name of each: columns of any name go through an operator unharmed."""
    names = {f"given_{n}": c for n, c in enumerate(df.columns)}
    return df.toDF(*names), {c: own for own, c in names.items()}


def as_given(df: DataFrame, own: dict[str, str]) -> DataFrame:
    """Columns of :func:`set_apart` by their given names again; other columns, whose names must be free, stay."""
    given = {o: c for c, o in own.items()}
    return df.toDF(*[given.get(c, c) for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; in a local session without one, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def cut(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at replicated files.

    Columns named in ``folders`` part the files into folders, so that a filter on them reads only its own.
    """
    spark = ready(df).sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _MADE.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.discard(path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that :func:`cut` has made and nobody has discarded; results that still read them are gone with them."""
    for path in sorted(_MADE):
        _delete(spark, path)


def _sweep_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the session may be ending too
            sweep(spark)


atexit.register(_sweep_at_exit)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no later read needs, and now and then let Spark drop shuffles nobody holds."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)
    if tables and time.monotonic() - _collected > 5:
        drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds."""
    global _collected
    gc.collect()
    spark._jvm.System.gc()
    _collected = time.monotonic()


HOT = 1000


def join_hot(rows: DataFrame, per_key: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``per_key``, which has a row for each of the keys and how many of the ``total`` rows have it (``n``).

    Keys of more than a HOT-th of the rows, so fewer than HOT of them, are joined by broadcast: their rows stay where they
    are.  The others are shuffled, a key with at most that share.
    """
    most = total // HOT
    hot = F.broadcast(per_key.where(F.col("n") > most))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(per_key.where(F.col("n") <= most), keys)
    return rows.join(hot, keys).unionByName(cold)


@contextlib.contextmanager
def bloom_filters(spark: SparkSession) -> Iterator[None]:
    """Joins run in this block may filter their larger side by a Bloom filter of the other's keys, whatever their sizes.

    The filter has a fixed most size (``spark.sql.optimizer.runtime.bloomFilter.maxNumBits``); a full one only filters less.
    """
    head = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {f"{head}enabled": "true", f"{head}applicationSideScanSizeThreshold": "1", f"{head}creationSideThreshold": "64g"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def let(value: Column, body) -> Column:
    """``body`` of a column that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, start: Column, kind: str, step) -> Column:
    """The outputs of a fold over an array: ``step(state, x)`` gives the next state and an output of type ``kind``.

    Outputs are gathered in blocks of SCAN_BLOCK, so a text with many items costs in proportion to them.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(acc: Column, some: Column) -> Column:
        folded = F.aggregate(some, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(folded, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def blocks(all_: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / SCAN_BLOCK).cast("int"))
        return F.transform(at, lambda k: F.slice(all_, k * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)))

    begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    folded = let(items, lambda all_: F.when(F.size(all_) > 0, F.aggregate(blocks(all_), begin, block, lambda acc: F.flatten(acc["out"]))))
    return F.coalesce(folded, none)


SCAN_BLOCK = 128
SPAN = "struct<s:int,e:int,m:string,before:string>"


def match_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<s,e,m,before>>, offsets in code points.

    ``split`` gives the gaps, ``regexp_extract_all`` the hits; offsets are running sums of their lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(hits.alias("m"), F.split(text, pattern, -1).alias("g"))

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        s = pos + F.char_length(x["g"])
        e = s + F.char_length(x["m"])
        return e, F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(32)).alias("before")).cast(SPAN)

    found = scan(F.filter(zipped, lambda x: x["m"].isNotNull()), F.lit(0), SPAN, step)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))

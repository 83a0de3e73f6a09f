"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Targets.  Each source gets its weight's share of the words; a source whose share passes ``max_epochs`` times its size
is clamped there and what it leaves goes to the others by weight, again and again until no share is above its cap.

Sampling.  target / size = whole + fraction.  Every document is taken ``whole`` times; documents worth the fraction are
taken once more: those first in a seeded hash order, up to the words wanted, without documents longer than that.  What the last one leaves open is closed by at
most ``FINE`` steps, each taking one document of the source once more or once less.  The order is cut with sums over hash buckets, so no task sees a whole source.

Defined cases: null text has no words; null is a source of its own and the last in order; sources without words get
target 0; repeated rows count one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import as_given, cut, discard, set_apart

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BUCKET_BITS = 12
FINE = 4


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) with a target for each source; the table holds a row for each source."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = None
    while True:
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) < cap
        w, used = sources.agg(
            F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, cap))
        ).first()
        new = (total - (used or 0.0)) / w if w else level
        if not w or (level is not None and new <= level):
            break
        level = new
    if level is None:
        level = 0.0
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    key: Column | None = None,
) -> DataFrame:
    """(id, source, size, source_size, target, taken, times, key): a row for each row of ``df``; ``key``: what it is known by."""
    shift, order = 64 - BUCKET_BITS, F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    docs = cut(
        df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order.alias("order"), (order if key is None else key).alias("key"))
        .withColumn("h", F.xxhash64(F.lit(seed), "order"))
        .withColumn("bucket", F.shiftrightunsigned("h", shift).cast("int"))
        .withColumn("row", F.monotonically_increasing_id()),
        "mix-docs",
    )
    ranked = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(ranked - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = cut(docs.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight), "mix-sources")
    plan = water_fill(sources, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio + F.lit(1e-12)).cast("long")).withColumn(
        "want", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")
    )
    plan = cut(plan.select(F.col("source").alias("src"), "source_size", "target", "whole", "want"), "mix-plan")
    same = F.col("source").eqNullSafe(F.col("src"))
    able = F.col("size") <= F.col("want")  # a longer document cannot be part of the fraction
    buckets = cut(docs.join(plan, same).where(able).groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    # The bucket in which the wanted words run out: all before it are taken.
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        buckets.withColumn("upto", F.sum("words").over(run))
        .join(plan, same)
        .groupBy(F.col("source").alias("source2"))
        .agg(
            F.min(F.when(F.col("upto") > F.col("want"), F.col("bucket"))).alias("edge"),
            F.max(F.when(F.col("upto") <= F.col("want"), F.col("upto"))).alias("before"),
        )
    )
    edge = plan.join(ends, F.col("src").eqNullSafe(F.col("source2")), "left").drop("source2")
    edge = cut(edge.withColumn("before", F.coalesce("before", F.lit(0))), "mix-edge")
    dealt = docs.join(edge, same)
    in_edge = Window.partitionBy("source").orderBy("h", "order", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = cut(
        dealt.where(able & (F.col("bucket") == F.col("edge")))
        .withColumn("upto", F.col("before") + F.sum("size").over(in_edge))
        .select("row", (F.col("upto") <= F.col("want")).alias("fits")),
        "mix-split",
    )
    marked = dealt.join(split, "row", "left").withColumn(
        "extra", able & F.coalesce(F.col("fits"), F.col("bucket") < F.col("edge"), F.lit(True))
    )
    marked = cut(marked.select("id", "key", "source", "size", "source_size", "target", "whole", "want", "row", "h", "extra"), "mix-marked")
    times, steps = F.col("whole") + F.col("extra").cast("long"), None
    for _ in range(FINE):  # one document of a source once more or once less, whichever comes nearest
        rows = _stepped(marked, steps).withColumn("times", times + F.col("step"))
        left = rows.groupBy("source").agg((F.first("want") - F.sum(F.col("size") * (F.col("times") - F.col("whole")))).alias("left"))
        left = left.select(F.col("source").alias("src"), "left").where("left != 0")
        miss = F.abs(F.abs("left") - F.col("size"))
        free = F.when(F.col("left") > 0, F.col("times") < max_epochs).otherwise(F.col("times") > 0)
        best = (
            rows.join(left, same)
            .where(free & (miss < F.abs("left")))
            .groupBy("source")
            .agg(F.min(F.struct(miss.alias("miss"), "h", "row", F.signum("left").cast("long").alias("step"))).alias("top"))
            .select("top.row", "top.step")
        )
        best = cut(best, "mix-step")
        steps = best if steps is None else steps.unionByName(best)
    out = _stepped(marked, steps).withColumn("times", times + F.col("step"))
    out = out.select("id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "key")
    discard(docs, buckets, sources, plan, edge, split)
    return out


def _stepped(marked: DataFrame, steps: DataFrame | None) -> DataFrame:
    if steps is None:
        return marked.withColumn("step", F.lit(0))
    summed = steps.groupBy("row").agg(F.sum("step").alias("step"))
    return marked.join(summed, "row", "left").withColumn("step", F.coalesce("step", F.lit(0)))


def whole_key(df: DataFrame) -> Column:
    """128 bits of all columns' values; a null is not the same as a value in another column.  Maps and variants, which have no hash, count as their JSON."""
    plain = lambda f: F.to_json(F.struct(f.name)) if re.search(r"\b(map<|variant\b)", f.dataType.simpleString()) else F.col(f.name)
    cells = [x for f in df.schema.fields for x in (F.col(f.name).isNull(), plain(f))]
    return F.struct(F.xxhash64(F.lit(1), *cells).alias("a"), F.xxhash64(F.lit(2), *cells).alias("b"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df`` with each row as often as the mix takes it.

    Rows are known by all their columns: only rows that are the same in each stand for each other, and their repetitions add up.
    """
    df, own = set_apart(df)
    how["source_col"] = own[how.get("source_col", "source")]
    keyed = df.withColumn("_key", whole_key(df))
    times = mix(keyed, id_col=own[id_col], text_col=own[text_col], key=F.col("_key"), **how).groupBy("key").agg(F.sum("times").cast("int").alias("_times"))
    one = keyed.join(times.where("_times > 0").withColumnRenamed("key", "_key"), "_key").dropDuplicates(["_key"])
    return as_given(one.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*df.columns), own)

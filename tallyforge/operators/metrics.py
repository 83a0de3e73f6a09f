"""Rollups of file metrics: language, category, project, snapshot; shares; merging a fresh scan into a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUMS = ["bytes", "tokens", "physical", "blank", "code", "comment", "mixed", "content"]


def by_language(files: DataFrame, *keys: str) -> DataFrame:
    """A row for each (keys, language, category), most code and content first."""
    out = files.groupBy(*keys, "language", "category").agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in SUMS])
    return out.withColumn("lines", F.col("code") + F.col("content")).orderBy(F.desc("lines"), "language")


def by_category(files: DataFrame, *keys: str) -> DataFrame:
    return files.groupBy(*keys, "category").agg(
        F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"), F.sum("physical").alias("physical"),
        F.sum(F.col("code") + F.col("content")).alias("lines"),
    )


def rollup(files: DataFrame, *keys: str) -> DataFrame:
    """All levels at once, from single keys to the grand total (nulls)."""
    return files.rollup(*keys).agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in SUMS])


def shares(languages: DataFrame, project: str = "project_id") -> DataFrame:
    """Each language's share of its project's physical lines."""
    total = F.sum("physical").over(Window.partitionBy(project))
    return languages.withColumn("share", F.when(total > 0, F.col("physical") / total).otherwise(0.0))


def merge_snapshot(previous: DataFrame, fresh: DataFrame, order: DataFrame) -> DataFrame:
    """Fresh projects replace those of the previous snapshot of the same scope and tokenizer; others of it go.

    ``order``: (project_id, ord), the configured projects; projects not in it go as well.
    """
    same = fresh.select("scope", "tokenizer").distinct()
    kept = previous.join(F.broadcast(same), ["scope", "tokenizer"], "left_semi").join(fresh, "project_id", "left_anti")
    return kept.unionByName(fresh).join(order, "project_id").orderBy("ord").drop("ord")


def new_projects(existing: DataFrame, added: DataFrame, key: str = "root_key") -> DataFrame:
    """Added projects whose normalised folder is not configured yet, the first of each folder."""
    first = added.groupBy(key).agg(F.min_by(F.struct(*added.columns), "ord").alias("r")).select("r.*")
    return first.join(existing, key, "left_anti")


def manifest_diff(previous: DataFrame, current: DataFrame, version: str, rescan: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changed, reusable) files by path, size, modification time and reader version."""
    known = previous.where(F.lit(not rescan) & (F.col("version") == version)).select("path", "length", "modified")
    keys = ["path", "length", "modified"]
    return current.join(known, keys, "left_anti"), current.join(known, keys, "left_semi")

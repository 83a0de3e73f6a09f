"""Exact dedup by a tree-merge of digest runs (DataFrame functions only).

Rows are dealt to ``fan_in ** rounds`` runs.  Each run is reduced to one entry per digest; then runs meet in rounds,
``fan_in`` at a time, until one remains.  An entry holds the surviving identifier and the number of rows.  A key of a
round is (run, digest), so a group that holds a third of all rows is spread over all runs in the first round and is at
most ``fan_in`` entries per key in each later one.  The survivors travel down the same tree to the rows.

Digests are SHA-256 of the normalised text; every merge also compares the byte length and an independent 64-bit hash,
so entries meet only where all three agree.

Defined cases: null text counts as empty; rows without an identifier lose against any identifier; of rows that repeat
text and identifier exactly one is ``kept``; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_given, cut, set_apart

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["sha", "bytes", "check"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts of single-byte characters take the quick way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def tree_rounds(df: DataFrame, fan_in: int) -> int:
    """Rounds so that there are at least as many runs as shuffle partitions."""
    parts, rounds = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1
    while fan_in**rounds < parts:
        rounds += 1
    return rounds


def dedup_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for each input row."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    missing = F.col("id").isNotNull() if keep == "largest" else F.col("id").isNull()
    text = ascii_lower(F.col(text_col))
    rounds = tree_rounds(df, fan_in)
    rows = cut(
        df.select(F.col(id_col).alias("id"), text.alias("norm"))
        .select(
            "id",
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.octet_length("norm").alias("bytes"),
            F.xxhash64("norm").alias("check"),
        )
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("run", F.pmod(F.xxhash64("row"), F.lit(fan_in**rounds)).cast("int")),
        "dedup-rows",
    )
    entry = F.struct(missing.alias("missing"), F.col("id").alias("id"), F.col("row").alias("row"))
    levels = [rows.groupBy("run", *KEY).agg(best(entry).alias("top"), F.count(F.lit(1)).alias("n"))]
    for _ in range(rounds):
        run = F.floor(F.col("run") / fan_in).cast("int").alias("run")
        levels.append(levels[-1].groupBy(run, *KEY).agg(best("top").alias("top"), F.sum("n").alias("n")))
    found = levels[-1]
    for level in reversed(levels[:-1]):  # down again: at most fan_in entries meet one survivor
        up = found.select(F.col("run").alias("up"), *KEY, "top", "n")
        found = level.select("run", F.floor(F.col("run") / fan_in).cast("int").alias("up"), *KEY).join(up, ["up", *KEY])
    out = rows.join(found.select("run", *KEY, "top", "n"), ["run", *KEY])
    return out.select(
        "id",
        F.col("top.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("top.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``df`` with one row of each group of equal texts, all its columns unchanged."""
    df, own = set_apart(df)
    id_col, text_col = own[id_col], own[text_col]
    kept = dedup_classes(df, id_col, text_col, keep).where("kept").select(F.col("id").alias("_id"), F.col("text_sha256").alias("_sha"))
    marked = df.withColumn("_key", F.sha2(ascii_lower(F.col(text_col)), 256))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_sha"))
    return as_given(marked.join(kept, same, "left_semi").dropDuplicates([id_col, "_key"]).select(*df.columns), own)


ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

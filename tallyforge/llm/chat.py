"""Multi-party perspective rotation (DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as
named users.  The result has a row for each turn and perspective: the rendered segment, its place in the rendered
dialogue and the span to learn from (the assistant's words and end mark).  ``render`` joins the segments.

A conversation may hold a third of all rows, so none is gathered into a task: turns are range-sorted, places are running
sums inside a sorted part, and each part gets what the parts before it add up to.

Defined cases: a null speaker is ``unknown`` and a null text empty; null turns come first; ties go by speaker, then
text; repeated rows are turns of their own; null conversation ids form one conversation; an empty table gives an empty
result; ``<|`` in what a speaker said or is called becomes ``<||``, so that nobody can forge the marks of a turn.  Offsets are
code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut

OPEN_ASSISTANT, OPEN_USER, CLOSE = "<|assistant|>\n", "<|user:{}|>\n", "<|end|>\n"


def rotate(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, perspective, seq, turn, speaker, segment, start, end, learn_start, learn_end)."""
    order = ["conv", "turn", "speaker", "text"]
    turns = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.replace(F.coalesce(F.col(speaker), F.lit("unknown")), F.lit("<|"), F.lit("<||")).alias("speaker"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("<||")).alias("text"),
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    turns = cut(
        turns.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "chat-turns",
    )
    people = turns.groupBy(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).agg(F.count(F.lit(1)).alias("_n"))
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit(OPEN_ASSISTANT)).otherwise(F.concat(F.lit("<|user:"), "speaker", F.lit("|>\n")))
    segs = turns.join(people, F.col("conv").eqNullSafe(F.col("c"))).select(
        "conv", "perspective", "part", "turn", "speaker", "text", "row",
        F.char_length(head).alias("head"),
        F.concat(head, "text", F.lit(CLOSE)).alias("segment"),
    )
    segs = cut(segs.withColumn("size", F.char_length("segment").cast("long")), "chat-segments")
    before = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = segs.groupBy("conv", "perspective", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    base = base.select(
        F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("pt"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"),
    )
    inside = Window.partitionBy("conv", "perspective", "part").orderBy("turn", "speaker", "text", "row")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = segs.withColumn("upto", F.sum("size").over(upto)).withColumn("rn", F.row_number().over(inside))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("pt"))
    placed = placed.join(base, same)
    end = F.col("base") + F.col("upto")
    start = end - F.col("size")
    return placed.select(
        F.col("conv").alias("conv_id"),
        "perspective",
        (F.col("base_n") + F.col("rn") - 1).alias("seq"),
        "turn",
        "speaker",
        "segment",
        start.alias("start"),
        end.alias("end"),
        F.when(own, start + F.col("head")).alias("learn_start"),
        F.when(own, end).alias("learn_end"),
    )


def render(rotated: DataFrame) -> DataFrame:
    """Whole dialogues of :func:`rotate`'s rows: (conv_id, perspective, rendered, masks); for dialogues that fit a row."""
    turn = F.struct("seq", "segment", "learn_start", "learn_end")
    turns = F.array_sort(F.collect_list(turn))
    return rotated.groupBy("conv_id", "perspective").agg(turns.alias("turns")).select(
        "conv_id",
        "perspective",
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("rendered"),
        F.transform(
            F.filter("turns", lambda t: t["learn_start"].isNotNull()),
            lambda t: F.struct(t["learn_start"].alias("start"), t["learn_end"].alias("end")),
        ).alias("masks"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<||') AS speaker, replace(coalesce(text, ''), '<|', '<||') AS text FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS seq FROM t
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
s AS (
  SELECT n.conv_id, perspective, seq, turn, speaker,
    CASE WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user:' || speaker || '|>' END || chr(10) AS head,
    n.text || '<|end|>' || chr(10) AS rest
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
), e AS (
  SELECT *, CAST(sum(length(head) + length(rest)) OVER (
    PARTITION BY conv_id, perspective ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM s
)
SELECT conv_id, perspective, seq, turn, speaker, head || rest AS segment,
  "end" - length(head) - length(rest) AS start, "end",
  CASE WHEN speaker = perspective THEN "end" - length(rest) END AS learn_start,
  CASE WHEN speaker = perspective THEN "end" END AS learn_end
FROM e
"""

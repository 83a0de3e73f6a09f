"""Phrase collocation mining: exact weighted n-gram counts, out of core, and the strongest phrases of each language.

1. Texts are cut into pieces; equal pieces of a language become one with a multiplicity.
2. For each length, tasks turn pieces into n-grams and sum them chunk by chunk in DuckDB, so a frequent n-gram leaves a
   task once a chunk.  Sums are dealt to hash buckets as sorted, compressed lists, and each bucket is summed in DuckDB,
   which spills beyond MEMORY.  A spill file belongs to the task and goes with it.
3. Each candidate asks for the counts of its parts.  Requests for the same part are counted first: parts with more than
   a thousandth of all requests are answered by broadcast (at most a thousand), the others meet at the part's hash.
4. Scores are whole numbers in Python's integers.  The best of each language are taken in parts, then together.

Defined cases: null text is empty; null language is ``und``, as is the language of that name; texts without words give
nothing; equal rows count one by one; an empty table gives an empty result; other columns are not looked at.  Memory
follows the longest single text, and MEMORY for each task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut, discard, drop_shuffles, join_hot, ready
from .exact_dedup import LOWER, UPPER, ascii_lower

BREAK = r"[.,;:!?\x0A-\x0D]"
MAX_WORDS = 3
MIN_COUNT = 10
SHARE = 50
TOP = 2000
FAN_IN = 16
SCALE = 1_000_000
CHUNK_BYTES = 8 << 20
MEMORY = "256MB"
PARTS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
LISTS = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("grams", pa.binary()), ("counts", pa.binary())])


def pieces(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): pieces with single spaces between their words, and how often they occur."""
    text = ascii_lower(F.col(text_col))
    rows = df.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), text.alias("text"))
    spaced = F.contains("text", F.lit("\t")) | F.contains("text", F.lit("  "))
    rows = rows.withColumn("text", F.when(spaced, F.regexp_replace("text", r"[\x20\t]+", " ")).otherwise(F.col("text")))
    cutting = rf"\x20?{BREAK}(?:{BREAK}|\x20)*"
    rows = rows.select("lang", F.explode(F.split("text", cutting)).alias("piece")).select("lang", F.btrim("piece").alias("piece"))
    return rows.where("piece != ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))


@contextmanager
def engine() -> Iterator[duckdb.DuckDBPyConnection]:
    """A DuckDB of one thread and bounded memory, whose spill files end with the block."""
    with tempfile.TemporaryDirectory(prefix="grams-") as spill:
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False})
        try:
            yield con
        finally:
            con.close()


def grams_sql(words: int, buckets: int) -> str:
    """Sums of the n-grams of ``words`` words of the pieces in ``chunk``, in order of bucket, language and n-gram."""
    shifted = [f"unnest(w[{k + 1}:{k - words}])" for k in range(words)]
    return f"""
      WITH s AS (SELECT lang, n, string_split(piece, ' ') AS w FROM chunk),
      g AS (SELECT lang, {" || ' ' || ".join(shifted)} AS gram, n FROM s WHERE len(w) >= {words}),
      t AS (SELECT lang, gram, sum(n)::BIGINT AS n FROM g GROUP BY ALL)
      SELECT (hash(lang, gram) % {buckets})::INTEGER AS bucket, lang, gram, n FROM t ORDER BY bucket, lang, gram"""


def dealt(words: int, buckets: int) -> Callable:
    """Pieces to lists of n-grams by bucket and language."""

    def lists(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
        lang = pc.dictionary_encode(table["lang"]).combine_chunks()
        code = lang.indices.to_numpy()
        edge = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(code) != 0)) + 1
        edge = np.concatenate([[0], edge, [len(bucket)]])
        grams = table["gram"].combine_chunks()
        grams = grams if isinstance(grams, pa.Array) else pa.concat_arrays(grams.chunks)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), grams.cast(pa.string())), "\n")
        squeeze = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[edge[:-1]], pa.int32()),
                lang.dictionary.take(pa.array(code[edge[:-1]])).cast(pa.string()),
                pa.array([squeeze(x.as_buffer()) for x in joined], pa.binary()),
                pa.array([squeeze(n[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
            ],
            schema=LISTS,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sql = grams_sql(words, buckets)
        with engine() as con:

            def summed(chunk: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                con.register("chunk", pa.Table.from_batches(chunk))
                yield from lists(con.sql(sql).to_arrow_table())
                con.unregister("chunk")

            chunk, held = [], 0
            for batch in batches:
                chunk.append(batch)
                held += batch.nbytes
                if held >= CHUNK_BYTES:
                    yield from summed(chunk)
                    chunk, held = [], 0
            if chunk:
                yield from summed(chunk)

    return run


def totals(least: int) -> Callable:
    """Lists of a bucket to its n-grams that occur ``least`` times or more."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                grams = pc.split_pattern(pa.array([expand(row["grams"]).decode()], pa.large_string()), "\n").flatten()
                counts = np.frombuffer(expand(row["counts"]), np.int64)
                lang = pa.repeat(pa.scalar(row["lang"], pa.string()), len(counts))
                yield pa.RecordBatch.from_arrays([lang, grams.cast(pa.string()), pa.array(counts)], schema=PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with engine() as con:
            con.register("parts", pa.RecordBatchReader.from_batches(PARTS, parts(batches)))
            found = con.sql(f"SELECT lang, gram, sum(n)::BIGINT AS n FROM parts GROUP BY ALL HAVING sum(n) >= {least}")
            for out in found.to_arrow_reader(65536):
                yield out.cast(PARTS)

    return run


def gram_counts(found: DataFrame, words: int, least: int = 1) -> DataFrame:
    """(lang, gram, n) of all n-grams of ``words`` words that occur ``least`` times or more in ``found`` (lang, piece, n)."""
    buckets = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    lists = found.select("lang", "piece", "n").mapInArrow(dealt(words, buckets), "bucket int, lang string, grams binary, counts binary")
    return lists.repartitionById(buckets, "bucket").mapInArrow(totals(least), "lang string, gram string, n long")


def part_requests(candidates: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, a, cut, side, part): both parts of each cut of each candidate."""
    words = F.split("phrase", " ")
    asked = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(words) - 1),
            lambda k: F.array(
                F.struct(k.alias("cut"), F.lit(0).alias("side"), F.array_join(F.slice(words, 1, k), " ").alias("part")),
                F.struct(k.alias("cut"), F.lit(1).alias("side"), F.array_join(F.slice(words, k + 1, F.lit(max_words)), " ").alias("part")),
            ),
        )
    )
    return candidates.select("lang", "phrase", "a", F.explode(asked).alias("x")).select("lang", "phrase", "a", "x.*")


def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, a, l, r, score) by the cut that scores least, from the counts of all parts."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            a, of = row["a"], {(x["cut"], x["side"]): x["f"] for x in row["parts"]}
            score, k = min((SCALE * a * a // (of[k, 0] * of[k, 1]), k) for k, side in of if side == 0)
            out.append((row["lang"], row["phrase"], a, of[k, 0], of[k, 1], score))
        names, kinds = ["lang", "phrase", "a", "l", "r", "score"], [pa.string(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=names)


def contained(candidates: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, most): phrases inside longer candidates and the largest count of those."""
    words = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size(words) - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.size(words) - m + 1), lambda k: F.array_join(F.slice(words, k, m), " ")),
        )
    )
    longer = candidates.where(F.size(words) > 2).select("lang", "a", F.explode(inner).alias("phrase"))
    return longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, share: int = SHARE
) -> tuple[DataFrame, DataFrame]:
    """All phrases that count, (lang, phrase, a, l, r, score), and (lang, n), the words of each language."""
    spark = ready(df).sparkSession
    found = cut(pieces(df, text_col, lang_col), "phrase-pieces")
    drop_shuffles(spark)
    counts = []
    for k in range(1, max_words + 1):
        counts.append(cut(gram_counts(found, k, min_count if k > 1 else 1), "phrase-counts"))
        drop_shuffles(spark)
    discard(found)
    n = cut(counts[0].groupBy("lang").agg(F.sum("n").alias("n")), "phrase-words")
    candidates = reduce(DataFrame.unionByName, counts[1:]).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    known = reduce(DataFrame.unionByName, counts).select("lang", F.col("gram").alias("part"), F.col("n").alias("f"))
    asked = part_requests(candidates, max_words)
    per_part = cut(asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")).join(known, ["lang", "part"]), "phrase-parts")
    total = per_part.agg(F.sum("n")).first()[0] or 0
    answers = join_hot(asked, per_part, ["lang", "part"], total).groupBy("lang", "phrase", "a")
    rows = answers.agg(F.collect_list(F.struct("cut", "side", "f")).alias("parts"))  # two for each cut
    rows = rows.mapInArrow(scored, "lang string, phrase string, a long, l long, r long, score long")
    inside = contained(candidates, max_words)
    weak = F.col("most").isNotNull() & (F.col("most").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(38,0)") * share)
    return rows.join(inside, ["lang", "phrase"], "left").where(~weak).drop("most"), n


def top_phrases(df: DataFrame, top: int = TOP, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, count and phrase."""
    found, n = collocations(df, **how)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]

    def first(rows: DataFrame, *key: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= top)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    best = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    while parts > 1:  # at most FAN_IN * top rows of a language meet in a task
        best, parts = first(best, "lang", "part").drop("rank").withColumn("part", F.floor(F.col("part") / FAN_IN)), -(-parts // FAN_IN)
    best = first(best, "lang")
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
q AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
f1 AS (SELECT lang, w AS x, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM q) GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM q WHERE len(w) > 1) GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM q WHERE len(w) > 2) GROUP BY ALL),
c AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, 1 AS k, u.f AS l, v.f AS r
  FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.x = f2.x JOIN f1 v ON v.lang = f2.lang AND v.x = f2.y WHERE f2.f >= {MIN_COUNT}
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 1, u.f, v.f
  FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.x = f3.x JOIN f2 v ON v.lang = f3.lang AND v.x = f3.y AND v.y = f3.z WHERE f3.f >= {MIN_COUNT}
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, u.f, v.f
  FROM f3 JOIN f2 u ON u.lang = f3.lang AND u.x = f3.x AND u.y = f3.y JOIN f1 v ON v.lang = f3.lang AND v.x = f3.z WHERE f3.f >= {MIN_COUNT}),
s AS (SELECT *, ({SCALE}::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM c
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(f) AS most FROM (
  SELECT lang, x || ' ' || y AS phrase, f FROM f3 WHERE f >= {MIN_COUNT} UNION ALL SELECT lang, y || ' ' || z, f FROM f3 WHERE f >= {MIN_COUNT}) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
FROM s JOIN n USING (lang) LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase
WHERE most IS NULL OR 100 * most < {SHARE} * a
QUALIFY rank <= {TOP}
"""

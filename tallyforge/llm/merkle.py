"""Merkle manifest of a dataset by Pregel-style supersteps over RDDs.

A row is a leaf.  The leaves of a source, in order of their identifiers, are the lowest level of its tree; FAN
consecutive nodes have one parent.  The sources' roots, in order of the sources, are the lowest level of the top tree.

Upwards, a superstep for each level: every node sends its digest to its parent; a parent that has got all its children
(their number follows from the level's width, which travels along) hashes them and is a node of the next superstep.  A
tree that has come down to one node is done.  Downwards, in reverse: a parent sends each child the path above it, its
own children's digests with the child's place first.  A path ends at the lowest run, whose up to FAN leaves share all
but their first step; there proofs are made and roots recomputed, so paths are never sent leaf by leaf.

Supersteps are cut by written tables, so a lost executor repeats one superstep at most.  Places come from a sort over
all rows by source and identifier, so a large source is spread; its rows meet its number and start by broadcast (at most
a thousand sources of more than a thousandth of the rows), other sources by a shuffle.

Defined cases: null is ``-`` in a leaf, so it differs from empty; rows without a source are a source of their own, the
first; rows without an identifier come first in their source and are not tampered with; rows that repeat an identifier
stand in order of their leaves; an empty table has no root and gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, join_hot, ready
from .exact_dedup import LOWER, UPPER, ascii_lower

FAN = 16
SIZE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<slot:int,digests:binary>>"
STEP = "tree long, place long, path " + PATH + ", subroot binary"
RUN = "tree long, place long, width long, digests binary, digest binary"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Iterable[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` or its length in bytes, ``:`` and its value."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hashed(digests: bytes) -> bytes:
    """A parent's digest: children's digests are hashed as hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height(width: int) -> int:
    """Levels of runs above ``width`` nodes."""
    levels = 0
    while width > 1:
        width, levels = -(-width // FAN), levels + 1
    return levels


def summed_before(rows: RDD, weight) -> RDD:
    """(row, its number, sum of ``weight`` of all rows before it); a pair for each partition passes through the driver."""

    def total(part: Iterator) -> Iterator[tuple[int, int]]:
        n = w = 0
        for row in part:
            n, w = n + 1, w + weight(row)
        yield n, w

    starts = [(0, 0)]
    for n, w in rows.mapPartitions(total).collect():
        starts.append((starts[-1][0] + n, starts[-1][1] + w))

    def run(k: int, part: Iterator) -> Iterator[tuple]:
        n, w = starts[k]
        for row in part:
            yield row, n, w
            n, w = n + 1, w + weight(row)

    return rows.mapPartitionsWithIndex(run)


def frame(spark: SparkSession, rows: RDD, schema, label: str) -> DataFrame:
    return cut(spark.createDataFrame(rows, schema, verifySchema=False), label)


# ---- upwards --------------------------------------------------------------------------------------------------------


def gathered(messages: RDD, parts: int) -> RDD:
    """((tree, place), (width, children by slot)): a node's children, of which there are FAN at most."""
    met = messages.reduceByKey(lambda x, y: (x[0], x[1] + y[1]), parts)

    def complete(value: tuple, key: tuple) -> tuple:
        width, children = value
        if len(children) != min(FAN, width - key[1] * FAN):
            raise RuntimeError(f"node {key} has {len(children)} children on a level of {width}")
        return width, sorted(children, key=lambda c: c[0])

    return met.map(lambda kv: (kv[0], complete(kv[1], kv[0])), preservesPartitioning=True)


def ascend(spark: SparkSession, nodes: DataFrame, widest: int, parts: int, label: str) -> list[DataFrame]:
    """The runs of each level above ``nodes`` (tree, width, place, digest), lowest first."""
    levels = []
    for _ in range(height(widest)):
        active = nodes.where("width > 1").select("tree", "place", "width", "digest").rdd
        sent = active.map(lambda r: ((r[0], r[1] // FAN), (r[2], [(r[1] % FAN, bytes(r[3]))])))

        def forward(kv: tuple) -> tuple:
            (tree, place), (width, children) = kv
            digests = b"".join(d for _, d in children)
            return tree, place, width, digests, hashed(digests)

        levels.append(frame(spark, gathered(sent, parts).map(forward), RUN, label))
        nodes = levels[-1].selectExpr("tree", f"(width + {FAN - 1}) div {FAN} AS width", "place", "digest")
    return levels


# ---- downwards ------------------------------------------------------------------------------------------------------


def told(runs: DataFrame, inbox: RDD, parts: int) -> RDD:
    """Messages (child, (path, subroot)) of the runs of a level that have got theirs."""
    keyed = runs.select("tree", "place", "digests").rdd.map(lambda r: ((r[0], r[1]), bytes(r[2])))

    def to_children(kv: tuple) -> Iterator[tuple]:
        (tree, place), (digests, (path, subroot)) = kv
        for slot in range(len(digests) // SIZE):
            yield (tree, place * FAN + slot), ([(slot, digests), *path], subroot)

    return keyed.join(inbox, parts).flatMap(to_children)


def written(spark: SparkSession, messages: RDD, label: str) -> RDD:
    """The messages, cut."""
    df = frame(spark, messages.map(lambda kv: (*kv[0], *kv[1])), STEP, label)
    return df.rdd.map(lambda r: ((r[0], r[1]), ([(p[0], bytes(p[1])) for p in r[2]], None if r[3] is None else bytes(r[3]))))


@dataclass
class Manifest:
    """Root and levels of a dataset's trees; ``leaves`` holds the lowest runs with their members."""

    spark: SparkSession
    root: bytes | None
    trees: DataFrame | None = None  # none, name, tree, start, n, subroot
    leaves: DataFrame | None = None  # tree, place, width, members, digest
    levels: tuple[DataFrame, ...] = ()
    top: tuple[DataFrame, ...] = ()
    parts: int = 1

    def paths(self) -> RDD:
        """((tree, place), (path, subroot)) for each of the lowest runs."""
        subroots = self.trees.select("tree", "subroot").rdd.map(lambda r: ((0, r[0]), bytes(r[1])))
        inbox = self.spark.sparkContext.parallelize([((0, 0), ([], None))], 1)
        for runs in reversed(self.top):
            inbox = written(self.spark, told(runs, inbox, self.parts), "merkle-down")
        heights = self.trees.select("tree", "n").rdd.map(lambda r: ((0, r[0]), max(height(r[1]), 1) - 1))
        # The last messages went to the trees: each goes to the run at its tree's top.
        begun = inbox.join(subroots.join(heights), self.parts).map(lambda kv: (kv[1][1][1], ((kv[0][1], 0), (kv[1][0][0], kv[1][1][0]))))
        begun = self.spark.createDataFrame(begun.map(lambda x: (x[0], *x[1][0], *x[1][1])), "level int, " + STEP, verifySchema=False)
        begun = cut(begun, "merkle-trees")
        inbox = None
        for level in range(len(self.levels), -1, -1):
            own = begun.where(F.col("level") == level).drop("level").rdd.map(lambda r: ((r[0], r[1]), ([(p[0], bytes(p[1])) for p in r[2]], bytes(r[3]))))
            inbox = own if inbox is None else inbox.union(own)
            if level:
                inbox = written(self.spark, told(self.levels[level - 1], inbox, self.parts), "merkle-down")
        return inbox


def manifest(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, when: Column | None = None
) -> Manifest:
    """The trees over the rows of ``df``.

    ``changed`` are other values of some fields, in columns of ``df``: where ``when`` holds, the leaf that they make is kept beside the row's own.
    """
    spark = ready(df).sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    other = F.lit(None).cast("binary")
    if changed:
        other = F.when(F.lit(True) if when is None else when, leaf_digest(changed.get(c, F.col(c)) for c in fields))
    source = F.col(source_col)
    rows = cut(
        df.select(
            source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("name"), F.col(id_col).alias("id"),
            leaf_digest(map(F.col, fields)).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("row"),
        ),
        "merkle-rows",
    )
    counts = rows.groupBy("none", "name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("none"), "name")
    kind = T.StructType([*(f for f in counts.schema.fields if f.name != "n"), T.StructField("tree", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])
    trees = frame(spark, summed_before(counts.rdd, lambda r: r[2]).map(lambda x: (x[0][0], x[0][1], x[1], x[2], x[0][2])), kind, "merkle-sources")
    sources, total, widest = trees.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    if not sources:
        return Manifest(spark, None)
    ordered = rows.orderBy(F.desc("none"), "name", F.asc_nulls_first("id"), "leaf", "row").select("none", "name", "id", "leaf", "other")
    placed = T.StructType([*ordered.schema.fields, T.StructField("at", T.LongType())])
    numbered = frame(spark, ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), placed, "merkle-order")
    leaves = join_hot(numbered, trees, ["none", "name"], total).selectExpr("tree", "at - start AS place", "n AS width", "id", "leaf", "other")

    def member(r) -> tuple:
        return (r[0], r[1] // FAN), (r[2], [(r[1] % FAN, r[3], bytes(r[4]), None if r[5] is None else bytes(r[5]))])

    def lowest(kv: tuple) -> tuple:
        (tree, place), (width, members) = kv
        digests = b"".join(m[2] for m in members)
        return tree, place, width, members, digests, hashed(digests) if width > 1 else digests

    one = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("leaf", T.BinaryType()), T.StructField("other", T.BinaryType())])
    low = T.StructType([T.StructField("tree", T.LongType()), T.StructField("place", T.LongType()), T.StructField("width", T.LongType()), T.StructField("members", T.ArrayType(one)), T.StructField("digests", T.BinaryType()), T.StructField("digest", T.BinaryType())])
    runs = frame(spark, gathered(leaves.rdd.map(member), parts).map(lowest), low, "merkle-leaves")
    nodes = runs.selectExpr("tree", f"(width + {FAN - 1}) div {FAN} AS width", "place", "digest")
    levels = ascend(spark, nodes, -(-widest // FAN), parts, "merkle-up")
    tops = nodes.where("width = 1").select("tree", "digest")
    for runs_of in levels:
        tops = tops.unionByName(runs_of.where(f"width <= {FAN}").select("tree", "digest"))
    trees = cut(trees.join(tops.withColumnRenamed("digest", "subroot"), "tree"), "merkle-trees")
    lowest_top = trees.select(F.lit(0).cast("long").alias("tree"), F.lit(sources).cast("long").alias("width"), F.col("tree").alias("place"), F.col("subroot").alias("digest"))
    top = ascend(spark, lowest_top, sources, parts, "merkle-top")
    root = (top[-1] if top else lowest_top).select("digest").first()[0]
    return Manifest(spark, bytes(root), trees, runs, tuple(levels), tuple(top), parts)


def proofs(found: Manifest, siblings: bool = False) -> DataFrame:
    """A row for each leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified; ``siblings`` adds them as list of digests, leaf to root.

    ``folded_root`` is made from the other leaf where there is one, else from the row's own, and the siblings.
    """
    spark, root = found.spark, found.root
    kind = spark.range(0).selectExpr("CAST(NULL AS BIGINT) AS id").schema["id"].dataType if root is None else found.leaves.schema["members"].dataType.elementType["id"].dataType
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.StringType()) for c in texts), T.StructField("verified", T.BooleanType())])
    if siblings:
        schema = schema.add("siblings", T.ArrayType(T.StringType()))
    if root is None:
        return spark.createDataFrame([], schema)

    def judged(kv: tuple) -> Iterator[tuple]:
        (width, members), (path, subroot) = kv[1]
        upper = "".join((d[: SIZE * s] + d[SIZE * (s + 1) :]).hex() for s, d in path)
        digests = b"".join(m[2] for m in members)
        known: dict[bytes, bytes] = {}

        def fold(node: bytes) -> bytes:
            if node not in known:
                above = node
                for s, d in path:
                    above = hashed(d[: SIZE * s] + above + d[SIZE * (s + 1) :])
                known[node] = above
            return known[node]

        for slot, id_, leaf, other in members:
            before, after = digests[: SIZE * slot], digests[SIZE * (slot + 1) :]
            proof = (before + after).hex() + upper
            now = leaf if other is None else other
            folded = fold(hashed(before + now + after) if width > 1 else now)
            row = (id_, leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256(proof.encode()).hexdigest(), folded.hex(), folded == root)
            yield (*row, [proof[k : k + 2 * SIZE] for k in range(0, len(proof), 2 * SIZE)]) if siblings else row

    own = found.leaves.select("tree", "place", "width", "members").rdd.map(
        lambda r: ((r[0], r[1]), (r[2], [(m[0], m[1], bytes(m[2]), None if m[3] is None else bytes(m[3])) for m in r[3]]))
    )
    return spark.createDataFrame(own.join(found.paths(), found.parts).flatMap(judged), schema, verifySchema=False)


def proof_digests(df: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of ``documents``; a fifth of the rows by CRC-32 is tampered with: A-Z in the text lower-cased."""
    lowered = F.when(F.col("text").isNotNull(), ascii_lower(F.col("text")))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return proofs(manifest(df, changed={"text": lowered}, when=tampered)).withColumnRenamed("id", "doc_id")


def _oracle(levels: int = 8, tops: int = 6) -> str:
    """The trees' levels one by one; a level above a tree's root leaves it as it is."""

    def h(text: str) -> str:
        names = [*FIELDS[:-1], text]
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in names) + ")"

    bits = ", -1" * 8
    crc = f"""xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT{bits}])),
      lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT))"""
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        f"""d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, {h("text")} AS leaf,
      CASE WHEN ({crc}) % 5 = 0 THEN {h(low)} END AS other FROM documents)""",
        """p0 AS (SELECT doc_id, s, leaf, coalesce(other, leaf) AS f, '' AS p, row_number() OVER w - 1 AS i FROM d
      WINDOW w AS (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf))""",
        "n0 AS (SELECT s, i, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM p0)",
    ]

    def climb(k: int, tree: str) -> list[str]:
        at = f"64 * (i % {FAN})::BIGINT"
        return [
            f"r{k} AS (SELECT {tree} AS tree, i // {FAN} AS j, any_value(n) AS n, string_agg(h, '' ORDER BY i) AS run FROM n{k} GROUP BY ALL)",
            f"""p{k + 1} AS (SELECT doc_id, s, leaf, i // {FAN} AS i{", subroot" if tree == "0" else ""},
      CASE WHEN n > 1 THEN sha256(left(run, {at}) || f || substr(run, {at} + 65)) ELSE f END AS f,
      CASE WHEN n > 1 THEN p || left(run, {at}) || substr(run, {at} + 65) ELSE p END AS p
      FROM p{k} JOIN r{k} ON r{k}.tree = {"0" if tree == "0" else f"p{k}.s"} AND r{k}.j = i // {FAN})""",
            f"n{k + 1} AS (SELECT tree AS s, j AS i, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h, (n + {FAN - 1}) // {FAN} AS n FROM r{k})",
        ]

    for k in range(levels):
        ctes += climb(k, "s")
    a, b = levels, levels + 1
    ctes += [
        f"p{b} AS (SELECT doc_id, p{a}.s, leaf, f, p, p{a}.s AS i, h AS subroot FROM p{a} JOIN n{a} USING (s))",
        f"n{b} AS (SELECT 0 AS s, s AS i, h, count(*) OVER () AS n FROM n{a})",
    ]
    for k in range(b, b + tops):
        ctes += climb(k, "0")
    end = b + tops
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, (SELECT h FROM n{end}) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT h FROM n{end}) AS verified FROM p{end}"


ORACLE = _oracle()

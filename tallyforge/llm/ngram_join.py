"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

1. Texts become sets of hashed shingles of ``WORDS`` words; texts of the same words form a class (copies).
2. Every class gets a label a tree, ``DEPTH`` minima of which each gives some bits, 64 in all.  The forest is the table of
   (tree, label) in order: a prefix trie whose nodes at a depth are the runs of labels with the same first bits.
3. Matching starts at whole labels.  The pairs of a node are verified exactly; then prefixes are shortened by one minimum,
   and only nodes with other members than any before are looked at, until the recall estimated from the links at hand
   reaches ``RECALL``: a link of similarity s stands for 1 / P(s) links, P(s) = 1 - (1 - s^depth)^TREES.  The same estimate
   says which depth is next: the longest that is expected to reach the target.  ``PRIOR`` links at the threshold are added, so
   that few links cannot end it early.  At ``floor_depth()`` every pair reaches the target.
4. Nodes with the same members are one bucket.  A class's text goes to its buckets, compressed, at most TREES a depth; all
   pairs of a bucket are verified as products of 0/1 matrices in blocks of at most ``BLOCK_ROWS`` classes, dealt over many
   tasks.  A pair counts in the first bucket that both are in.  A block returns a row for each class (links, and the
   smallest class that it is joined to there), so no pairs are written.
5. Components of the verified links are the groups.

A node, bucket or group may hold a third of all rows: sums are combined before they are shuffled, and keys with more than
a thousandth of the rows (at most a thousand of them) are joined by broadcast.

Defined cases: null text counts as empty; texts of fewer than WORDS words have one shingle, of all their words; texts
without words form one class without links; repeated rows are members of a class; a null id stays null, its group is
known by the other members; ids may be of any type that has an order; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ._arrays import blocks, lean, mix64, powers, runs_of, span_hashes, words
from ._common import as_given, bloom_filters, cut, discard, drop_shuffles, join_hot, ready, set_apart
from .graph import components

WORDS = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction: compared in whole numbers
TREES, DEPTH, RECALL, PRIOR = 16, 6, 0.9995, 100
BITS = [0, 12, 24, 36, 48, 56, 64]  # bits of a label that the first 0, 1, ... minima give
BLOCK_ROWS, TASK_BYTES = 512, 4 << 20
LEVEL = 6  # of compression of texts on their way to their buckets
STEPS = 40  # of similarity between the threshold and 1
COLUMNS = 4096
_rng = np.random.default_rng(42)
MULTIPLIERS = _rng.integers(1, 2**63, (TREES, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = [np.uint64(x) for x in _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def meets(similarity, depth: int):
    """The chance that a pair has the same prefix in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def floor_depth() -> int:
    """The longest prefix with which any pair that counts reaches the recall."""
    depth = DEPTH
    while depth > 1 and meets(THRESHOLD[0] / THRESHOLD[1], depth) < RECALL:
        depth -= 1
    return depth


def expected_recall(links: np.ndarray, now: int, then: int) -> float:
    """Recall at depth ``then`` by the links found at depth ``now``: how many there are in each step of similarity."""
    low = THRESHOLD[0] / THRESHOLD[1]
    at = np.append(low + (1 - low) * (np.arange(STEPS) + 0.5) / STEPS, low)
    there = np.append(links, PRIOR * meets(low, now)) / meets(at, now)
    return float((there * meets(at, then)).sum() / there.sum())


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles, their row, words of each row, and a hash of each row's word sequence."""
    n = len(offs) - 1
    starts, ends, row = words(buf, offs)
    h = span_hashes(buf, starts, ends)
    at = runs_of(row, n)
    count = np.diff(at)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    whole = mix64((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]] + count.astype(np.uint64))
    total = max(0, len(h) - WORDS + 1)
    grams = np.zeros(total, np.uint64)
    for j in range(WORDS):
        grams += mix64(h[j : j + total] + PLACES[j])
    inside = row[:total] == row[WORDS - 1 :][:total]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    hashes = np.concatenate([mix64(grams[inside]), whole[short]])
    of = np.concatenate([row[:total][inside], short])
    if len(short):
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    return hashes, of, count, whole


def labels(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The label of each row in each tree, rows x trees; every row has a shingle."""
    out = np.zeros((len(at) - 1, TREES), np.uint64)
    for t in range(TREES):
        for d in range(DEPTH):
            x = hashes * MULTIPLIERS[t, d]
            x ^= x >> np.uint64(32)
            least = mix64(np.minimum.reduceat(x * MULTIPLIERS[t, d - 1], at[:-1]))
            bits = BITS[d + 1] - BITS[d]
            out[:, t] |= least >> np.uint64(64 - bits) << np.uint64(64 - BITS[d + 1])
    return out


def _signatures(batches):
    for batch in batches:
        for lo, hi, buf, offs in blocks(batch.column(1)):
            n = hi - lo
            hashes, of, count, whole = shingles(buf, offs)
            keys = np.zeros((n, TREES), np.uint64)
            some = np.flatnonzero(count > 0)
            if len(some):
                at = np.append(np.searchsorted(of, some), len(of))
                keys[some] = labels(hashes, at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, n),
                    pa.array(whole.view(np.int64)),
                    pa.array(count.astype(np.int32)),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), TREES).cast(pa.list_(pa.int64())),
                ],
                names=["id", "seq", "n_words", "keys"],
            )


def _sets(batches):
    """(rep, text, size): texts compressed, as they travel between tasks, and the bytes of their sets.

    Sets of hashes do not compress: a text's takes several times the bytes of the compressed text that it comes from.
    """
    for batch in batches:
        for lo, hi, buf, offs in blocks(batch.column(1)):
            raw, at = buf.tobytes(), offs.tolist()
            packed = [zlib.compress(raw[a:b], LEVEL) for a, b in zip(at[:-1], at[1:])]
            _, of, _, _ = shingles(buf, offs)
            size = np.diff(runs_of(of, hi - lo)) * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary()), pa.array(size.astype(np.int64))], names=["rep", "text", "size"]
            )


def unpacked(texts: list[bytes]) -> list[np.ndarray]:
    """The set of each compressed text: sorted, without repeats."""
    sets = []
    for lo, hi, buf, offs in blocks(pa.array([zlib.decompress(t) for t in texts], pa.binary())):
        hashes, of, _, _ = shingles(buf, offs)
        at = runs_of(of, hi - lo)
        sets += [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return sets


def linked(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs reach the threshold: 0/1 matrix of all pairs of ``sets`` (sorted, without repeats); and their similarity."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    width = int(often.max() > 1) and int(column[-1]) + 1
    for lo in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((n, min(COLUMNS, width - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    num, den = THRESHOLD  # common / union >= num / den
    both = size[:, None] + size[None, :]
    out = common.astype(np.int64) * (num + den) >= num * both
    np.fill_diagonal(out, False)
    return out, common / np.maximum(both - common, 1)


def shared_before(seen: list[np.ndarray], bucket: int) -> np.ndarray:
    """Which pairs of rows have a bucket before this one in common."""
    ids = [x[x < bucket] for x in seen]
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    _, column, often = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
    many = often[column] > 1
    if not many.any():
        return np.zeros((len(ids), len(ids)), bool)
    part = np.zeros((len(ids), len(often)), np.float32)
    part[row[many], column[many]] = 1
    part = part[:, often > 1]
    return part @ part.T > 0


def lowest(links: np.ndarray) -> np.ndarray:
    """For each row the smallest row of its component."""
    label = np.arange(len(links))
    while True:
        new = label.copy()
        a, b = np.nonzero(links)
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(key, group):
    """Rows of one task: whole buckets, or the block pair (x, y) of one."""
    buckets, reps = group.column("bucket").to_numpy(), group.column("rep").to_numpy()
    order = np.lexsort((reps, buckets))
    buckets, reps = buckets[order], reps[order]
    side, texts, seen = group.column("side").to_numpy()[order], group.column("text"), group.column("seen")
    x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    edges = np.flatnonzero(np.diff(buckets)) + 1
    low = THRESHOLD[0] / THRESHOLD[1]
    links, root, steps = np.zeros(len(reps), np.int64), reps.copy(), np.zeros(STEPS, np.int64)
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(reps)]):
        found, alike = linked(unpacked([texts[int(i)].as_py() for i in order[a:b]]))
        if x != y:
            found &= side[a:b, None] != side[None, a:b]
        if not found.any():
            continue
        root[a:b] = reps[a:b][lowest(found)]
        found &= ~shared_before([seen[int(i)].values.to_numpy() for i in order[a:b]], int(buckets[a]))
        links[a:b] = found.sum(axis=1)
        at = (alike[found].astype(float) - low) / (1 - low) * STEPS
        steps += np.bincount(np.clip(at, 0, STEPS - 1).astype(np.int64), minlength=STEPS)
    known = np.flatnonzero(steps)
    return pa.concat_tables(
        [
            pa.table({"rep": reps, "links": links, "root": root, "step": pa.nulls(len(reps), pa.int32())}),
            pa.table({"rep": pa.nulls(len(known), pa.int64()), "links": steps[known], "root": pa.nulls(len(known), pa.int64()), "step": known.astype(np.int32)}),
        ]
    )


CHECKED = "rep long, links long, root long, step int"  # rows of a class, and of a step of similarity (links from both ends)


def _buckets(forest: DataFrame, rows: int, depth: int, before: list[DataFrame]) -> DataFrame:
    """(name, bucket, n, rep): the members of each set of two or more classes that is a node at the depth and was none before."""
    prefix = F.shiftrightunsigned("label", 64 - BITS[depth]).alias("prefix")
    runs = forest.select("tree", prefix, "rep")
    nodes = cut(
        runs.groupBy("tree", "prefix")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("t"))
        .where("n > 1")
        .select("tree", "prefix", "n", F.xxhash64("n", "s", "t").alias("name")),
        "near-nodes",
    )
    members = join_hot(runs, nodes, ["tree", "prefix"], rows).select("name", "n", "rep").distinct()
    for old in before:
        members = members.join(old.select("name").distinct(), "name", "left_anti")
    # Buckets of earlier rounds come first in the order that says where a pair counts.
    bucket = F.col("name").bitwiseAND(F.lit((1 << 58) - 1)) + F.lit(len(before) << 58)
    out = cut(members.select("name", bucket.alias("bucket"), "n", "rep"), "near-buckets")
    discard(nodes)
    return out


def _checked(sets: DataFrame, members: DataFrame, seen: DataFrame) -> DataFrame:
    """All pairs of the buckets ``members``, verified."""
    few = F.col("n") <= BLOCK_ROWS
    size = sets.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, members.count() // (2 * BLOCK_ROWS), 2 * size // TASK_BYTES)
    dealt = members.join(sets.drop("size"), "rep").join(seen, "rep")
    n_blocks = F.ceil(F.col("n") / (BLOCK_ROWS // 2)).cast("int")
    dealt = dealt.withColumn("side", F.when(few, 0).otherwise(F.pmod(F.xxhash64("rep"), n_blocks)).cast("int"))
    others = F.when(few, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n_blocks - 1))
    dealt = dealt.withColumn("other", F.explode(others)).select(
        "rep", "bucket", "text", "seen", "side",
        F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"),
        F.when(few, F.pmod(F.xxhash64("bucket"), F.lit(tasks))).otherwise(F.col("bucket")).alias("task"),
        few.alias("few"),
    )
    return cut(dealt.groupBy("few", "task", "x", "y").applyInArrow(_verify, CHECKED), "near-checked")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id, copy_of, n_copies, n_links): a row for each row of ``df``.

    group_id: smallest id of the texts joined by links, directly or over others; copy_of: smallest id of the texts with
    the same words; n_copies: how many those are; n_links: how many different texts are linked to this one.
    """
    return _grouped(df, id_col, text_col).select("id", "group_id", "copy_of", "n_copies", "n_links")


def _grouped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``near_groups`` with the class (seq, n_words) of each row and the root of its group, whatever its id."""
    spark, id_type = ready(df).sparkSession, df.schema[id_col].dataType.simpleString()
    kind = f"id {id_type}, seq long, n_words int, keys array<long>"
    rows = cut(df.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(_signatures), kind), "near-rows")
    # A class is known by its hash of the words and their number, as ids may be null or stand at different texts.
    classes = cut(
        rows.groupBy("seq", "n_words").agg(F.min("id").alias("low_id"), F.count(F.lit(1)).alias("n_copies"), F.first("keys").alias("keys")),
        "near-classes",
    )
    # Labels that no other has the first bits of, at the least depth, have no partner at any: they stay out of the forest.
    trees = classes.where("n_words > 0").select(F.col("seq").alias("rep"), F.posexplode("keys").alias("tree", "label"))
    trees = trees.withColumn("top", F.xxhash64("tree", F.shiftrightunsigned("label", 64 - BITS[floor_depth()])))
    common = cut(trees.groupBy("top").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-common")
    shared = join_hot(trees, common, ["top"], TREES * classes.count()).select("rep", "tree", "label")
    forest = cut(shared.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label"), "near-forest")
    n_labels = forest.count()
    discard(common)
    drop_shuffles(spark)
    known = classes.select("seq", "n_words", "low_id").where("n_words > 0")
    plain = _ids_tell_classes(rows, classes)
    rounds, fetched, parts, steps, depth = [], [], [], np.zeros(STEPS), DEPTH
    while True:
        new = _buckets(forest, n_labels, depth, rounds)
        rounds.append(new)
        wanted = new.select(F.col("rep").alias("seq")).distinct()
        for old in fetched:
            wanted = wanted.join(old.select(F.col("rep").alias("seq")), "seq", "left_anti")
        fetched.append(_sets_of(df, id_col, text_col, known.join(wanted, "seq", "left_semi"), plain))
        sets, members = reduce(DataFrame.unionByName, fetched), reduce(DataFrame.unionByName, rounds)
        seen = members.groupBy("rep").agg(F.sort_array(F.collect_list("bucket")).alias("seen"))  # at most TREES a round
        drop_shuffles(spark)
        parts.append(_checked(sets, new, seen))
        drop_shuffles(spark)
        for r in parts[-1].where("step is not null").groupBy("step").agg(F.sum("links").alias("n")).collect():  # at most STEPS
            steps[r.step] += r.n / 2
        if depth == floor_depth() or expected_recall(steps, depth, depth) >= RECALL:
            break
        depth = max([d for d in range(floor_depth(), depth) if expected_recall(steps, depth, d) >= RECALL], default=floor_depth())
    checked = reduce(DataFrame.unionByName, parts).where("rep is not null")
    links = checked.groupBy("rep").agg(F.sum("links").alias("n_links"))
    roots = cut(components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b"))), "near-roots")
    # The smallest id of a class or group; without any id, a name of its own.
    nameless = F.concat(F.lit("class-"), F.hex("seq")) if id_type == "string" else (-F.abs("seq") - 1).try_cast(id_type)
    own = F.coalesce("low_id", nameless)
    joined = classes.join(roots, F.col("seq") == F.col("node")).groupBy("root")
    ids = cut(joined.agg(F.coalesce(F.min("low_id"), F.min(own)).alias("group_id"), F.count(F.lit(1)).alias("n")), "near-ids")
    in_group = join_hot(roots, ids, ["root"], roots.count()).drop("n")
    info = (
        classes.select("seq", "n_words", own.alias("copy_of"), "n_copies")
        .join(links, F.col("seq") == F.col("rep"), "left")
        .join(in_group, F.col("seq") == F.col("node"), "left")
        .select(
            "seq", "n_words", "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("group_id", "copy_of").alias("group_id"), F.coalesce("root", "seq").alias("root"),
        )
    )
    info = cut(info, "near-info")
    discard(*fetched, *rounds, *parts, forest, classes, roots, ids)
    hot = info.select("seq", "n_words", F.col("n_copies").alias("n"), *[c for c in info.columns if c not in ("seq", "n_words")])
    return join_hot(rows.select("id", "seq", "n_words"), hot, ["seq", "n_words"], rows.count()).drop("n")


def _ids_tell_classes(rows: DataFrame, classes: DataFrame) -> bool:
    """Whether each class has an id and its smallest id stands at no other class's row."""
    if not classes.where("low_id is null and n_words > 0").isEmpty():
        return False
    at_low = rows.select("id", F.col("seq").alias("_seq"), F.col("n_words").alias("_n")).join(classes, F.col("id") == F.col("low_id"))
    return at_low.where("_seq != seq or _n != n_words").isEmpty()


def _sets_of(df: DataFrame, id_col: str, text_col: str, known: DataFrame, plain: bool) -> DataFrame:
    """(rep, text, size) of the classes ``known``, from one text of each."""
    known = cut(known, "near-known")
    some = known.where("n_words > 0")  # Spark makes a filter only of a side that has a predicate
    if plain:  # Spark's own Bloom filter of at most 8 MB keeps most texts without a candidate out of the shuffle.
        texts = df.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
        wanted = texts.join(some, F.col("node") == F.col("low_id")).dropDuplicates(["node"])
    else:  # texts are found by their words
        with_seq = df.select(F.col(text_col).alias("text")).mapInArrow(lean(_with_words), "text string, seq long, n_words int")
        wanted = with_seq.join(some, ["seq", "n_words"]).dropDuplicates(["seq"])
    sets = wanted.select(F.col("seq").alias("rep"), "text").mapInArrow(lean(_sets), "rep long, text binary, size long")
    with bloom_filters(df.sparkSession):
        sets = cut(sets, "near-sets")
    discard(known)
    return sets


def _with_words(batches):
    for batch in batches:
        for lo, hi, buf, offs in blocks(batch.column(0)):
            _, _, count, whole = shingles(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(whole.view(np.int64)), pa.array(count.astype(np.int32))],
                names=["text", "seq", "n_words"],
            )


def _tagged(where: int):
    """Rows with the class of their text in column ``where``."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in blocks(batch.column(where)):
                _, _, count, whole = shingles(buf, offs)
                tags = [pa.array(whole.view(np.int64)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *tags], names=[*batch.schema.names, "_seq", "_n"])

    return run


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group, that with the smallest id, or any if none has an id."""
    df, own = set_apart(df)
    return as_given(_one_of_each(df, own[id_col], own[text_col]), own)


def _one_of_each(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    groups = cut(_grouped(df, id_col, text_col).select("id", "seq", "n_words", "root"), "near-kept")
    least = F.min(F.struct(F.col("id").isNull(), "id", "seq", "n_words"))
    first = groups.groupBy("root").agg(least.alias("f")).select(F.col("f.id").alias("_id"), F.col("f.seq").alias("_s"), F.col("f.n_words").alias("_w"))
    first = cut(first, "near-first")
    # Ids that stand at texts of different classes; like null, they do not tell which row stays.
    key = F.struct("seq", "n_words")
    shared = groups.where("id is not null").groupBy("id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a != b").select("id")
    shared = cut(shared, "near-shared")
    first_shared = first.join(shared, F.col("_id") == F.col("id"), "left_semi")
    if first.where("_id is null").isEmpty() and shared.isEmpty():
        return df.join(first, F.col(id_col) == F.col("_id"), "left_semi").dropDuplicates([id_col]).select(*df.columns)
    plain = first.where("_id is not null").join(shared, F.col("_id") == F.col("id"), "left_anti")
    kept = df.join(plain, F.col(id_col) == F.col("_id"), "left_semi").dropDuplicates([id_col])
    rest = df.where(F.col(id_col).isNull()).unionByName(df.join(first_shared, F.col(id_col) == F.col("_id"), "left_semi"))
    schema = StructType([*df.schema.fields, StructField("_seq", LongType()), StructField("_n", IntegerType())])
    rest = rest.mapInArrow(lean(_tagged(df.columns.index(text_col))), schema)
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_seq") == F.col("_s")) & (F.col("_n") == F.col("_w"))
    rest = rest.join(first, same, "left_semi").dropDuplicates([id_col, "_seq", "_n"])
    return kept.select(*df.columns).unionByName(rest.select(*df.columns))

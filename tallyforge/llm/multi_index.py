"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in halves, each half has a codebook of K centroids, and a vector's cell is its pair of nearest
centroids.  A query walks pairs in falling order of summed similarity with a heap (the multi-sequence walk) until the
cells passed hold ``share`` of all vectors; the entries of those cells are reranked by the exact inner product.

Codebooks are fitted on at most ``SAMPLE`` vectors, those first in a hash order of the id; every vector is indexed.
``share`` is what gives ``RECALL`` on queries of that sample, measured against brute force.  K grows with the root
of the number of vectors, up to ``MAX_K``.

Cells are dealt to parts of about ``PART`` entries in the order of cells; a cell that is larger, such as that of a very
common vector, is cut over as many parts as it needs.  A query goes once to each part that holds cells of its; an entry goes
to its part once for every QUERY_BLOCK queries that ask there, and nowhere if none does.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; equal scores go to the smaller id; repeated ids are entries of their own, but never neighbours of that id; a
null id takes no part; fewer candidates than ``k`` are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._arrays import lean
from ._common import cut, discard, join_hot

SAMPLE, MAX_K, PER_CELL = 16384, 256, 32
PART, QUERY_BLOCK, STRIP = 4096, 2048, 128
RECALL, CALIBRATION = 0.95, 256


def _usable(batches, dim: int):
    """Ids, vectors as bytes of doubles and whether they ask, without those that take no part."""
    for batch in batches:
        ids, lists, asks = batch.columns
        lens = np.asarray(lists.value_lengths().fill_null(0))
        ok = (lens == dim) & np.asarray(ids.is_valid())
        picked = lists.filter(pa.array(ok))
        flat = picked.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        x = flat.reshape(-1, dim)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        x, (ids, asks) = x[good], [c.filter(pa.array(ok)).filter(pa.array(good)) for c in (ids, asks)]
        yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x], pa.binary()), asks], names=["vec_id", "vec", "asks"])


def stacked(column) -> np.ndarray:
    """The vectors of a binary column, rows x components."""
    if not len(column):
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(2 * x @ c.T - (c**2).sum(axis=1), axis=1)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from k vectors taken evenly; an empty centroid stays where it is."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        a = nearest_centroid(x, c)
        n = np.bincount(a, minlength=k)
        sums = np.stack([np.bincount(a, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def walk(s1: np.ndarray, s2: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells i * K + j in falling order of s1[i] + s2[j], until they hold ``want`` entries; empty cells are left out."""
    k = len(s1)
    o1, o2 = np.argsort(-s1, kind="stable").tolist(), np.argsort(-s2, kind="stable").tolist()
    a, b, count = (-s1[o1]).tolist(), (-s2[o2]).tolist(), counts.tolist()
    heap, out, have = [(a[0] + b[0], 0, 0)], [], 0
    done = [0] * k  # pairs (i, j < done[i]) have been passed
    while heap and have < want:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        cell = o1[i] * k + o2[j]
        if count[cell]:
            out.append(cell)
            have += count[cell]
        if j + 1 < k and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < k and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return out


def needed_share(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, k: int, recall: float) -> float:
    """The share of the sample's entries that its own queries have to pass to find ``recall`` of their neighbours."""
    n, size, half = len(x), len(c1), c1.shape[1]
    if n <= k + 1:
        return 1.0
    cell = nearest_centroid(x[:, :half], c1) * size + nearest_centroid(x[:, half:], c2)
    counts = np.bincount(cell, minlength=size * size)
    needs = []
    for i in np.unique(np.linspace(0, n - 1, CALIBRATION).astype(int)):
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argpartition(-s, k)[:k]
        pair = ((c1 @ x[i, :half])[:, None] + (c2 @ x[i, half:])[None, :]).ravel()
        order = np.argsort(-pair, kind="stable")
        upto = np.empty(size * size)
        upto[order] = np.cumsum(counts[order])
        needs.append(upto[cell[top]])
    return float(min(1.0, np.quantile(np.concatenate(needs), recall) / n))


def _top(scores: np.ndarray, x: np.ndarray, q: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of the entries with finite scores; ``ids`` ascend, so equal products keep the smaller id first."""
    scores = np.where(ids == own, -np.inf, scores)
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero((scores >= floor - 1e-9 * (1 + abs(floor))) & np.isfinite(scores)) if np.isfinite(floor) else np.flatnonzero(np.isfinite(scores))
    else:
        at = np.flatnonzero(np.isfinite(scores))
    exact = (x[at] * q).sum(axis=1)  # the same sum for equal vectors, wherever they stand
    best = np.argsort(-exact, kind="stable")[:k]
    return ids[at[best]], exact[best]


def search(
    df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of every vector for which ``queries`` holds.

    Identifiers are whole numbers, or texts of such; another text is an error of the cast.
    """
    spark, schema = df.sparkSession, "query_id long, rank int, vec_id long, score double"
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    lengths = df.where(F.col("v").isNotNull()).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None or not lengths["n"]:
        return spark.createDataFrame([], schema)
    dim = lengths["n"]
    half = (dim + 1) // 2
    table = cut(df.mapInArrow(lean(lambda it: _usable(it, dim)), "vec_id long, vec binary, asks boolean"), "ann-vectors")
    total = table.count()
    sample = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not total:
        return spark.createDataFrame([], schema)
    x = np.frombuffer(b"".join(r.vec for r in sample), np.float64).reshape(-1, dim)
    size = 1
    while size < MAX_K and (2 * size) ** 2 * PER_CELL <= total:
        size *= 2
    c1 = codebook(x[:, :half], size)
    c2 = codebook(x[:, half:], size) if half < dim else np.zeros((size, 0))
    share = needed_share(x, c1, c2, k, recall)

    def assign(batches):
        for batch in batches:
            v = stacked(batch.column(1))
            if len(v):
                cell = nearest_centroid(v[:, :half], c1) * size + nearest_centroid(v[:, half:], c2)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["vec_id", "vec", "asks", "cell"])

    indexed = cut(table.mapInArrow(lean(assign), "vec_id long, vec binary, asks boolean, cell int"), "ann-index")
    discard(table)
    counts = np.zeros(size * size, np.int64)  # K * K numbers
    for r in indexed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    before = np.cumsum(counts) - counts
    first, last = before // PART, np.maximum(before, before + counts - 1) // PART
    want = int(np.ceil(share * total)) + k

    def probe(batches):
        for batch in batches:
            out = ([], [], [], [])
            for own, q in zip(batch.column(0).to_pylist(), stacked(batch.column(1))):
                cells = np.array(walk(c1 @ q[:half], c2 @ q[half:], counts, want), np.int32)
                by_part: dict[int, list[int]] = {}
                for c in cells.tolist():
                    for p in range(int(first[c]), int(last[c]) + 1):
                        by_part.setdefault(p, []).append(c)
                for p, some in by_part.items():
                    for column, value in zip(out, (p, own, q.tobytes(), np.array(some, np.int32).tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                names=["part", "query_id", "q", "cells"],
            )

    def rerank(key, entries, asked):
        order = np.argsort(entries.column("vec_id").to_numpy(), kind="stable")
        ids, cell = entries.column("vec_id").to_numpy()[order], entries.column("cell").to_numpy()[order]
        v = stacked(entries.column("vec"))[order] if len(order) else np.zeros((0, dim))
        q, own = stacked(asked.column("q")), asked.column("query_id").to_numpy()
        cells, out = asked.column("cells").to_pylist(), ([], [], [])
        for lo in range(0, len(own) if len(ids) else 0, STRIP):
            strip = q[lo : lo + STRIP]
            open_ = np.zeros((len(strip), size * size), bool)
            for i, some in enumerate(cells[lo : lo + STRIP]):
                open_[i, np.frombuffer(some, np.int32)] = True
            scores = np.where(open_[:, cell], strip @ v.T, -np.inf)
            for i in range(len(strip)):
                got, exact = _top(scores[i], v, strip[i], ids, own[lo + i], k)
                for column, value in zip(out, (np.full(len(got), own[lo + i]), got, exact)):
                    column.append(value)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table(
            {"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2].astype(np.float64)}
        )

    asked = indexed.where("asks").groupBy("vec_id").agg(F.min("vec").alias("vec"))  # of repeated ids one asks, always the same
    probes = cut(asked.mapInArrow(lean(probe), "part long, query_id long, q binary, cells binary"), "ann-probes")
    needs = probes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / QUERY_BLOCK).cast("int"))
    needs = cut(needs, "ann-needs")
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block")
    dealt = join_hot(probes, needs, ["part"], needs.agg(F.sum("n")).first()[0] or 0).select("part", block, "query_id", "q", "cells")
    # An entry's part: its cell's place in the order of cells, moved on within a large cell by a hash of its id.
    place = spark.createDataFrame(pa.table({"cell": np.arange(size * size, dtype=np.int32), "before": before, "n": counts}))
    spread = F.pmod(F.xxhash64("vec_id"), F.col("n"))
    entries = (
        indexed.join(F.broadcast(place), "cell")  # K * K rows, at most 65,536
        .withColumn("part", F.floor((F.col("before") + spread) / PART))
        .join(needs.select("part", "blocks"), "part")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "block", "vec_id", "vec", "cell")
    )
    found = dealt.groupBy("part", "block").cogroup(entries.groupBy("part", "block"))
    hits = found.applyInArrow(lambda key, a, b: rerank(key, b, a), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = cut(out, "ann-found")
    discard(indexed, probes, needs)
    return out

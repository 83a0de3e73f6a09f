"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text is a sparse vector of length 1: hashed words with the square root of their share of the words, and each
structure statistic (and the length) as one of ``BINS`` bins; the metadata ``n_chars`` is one more, with a bin of its own for
null or a table without it.  The score is
sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairs of features interact at the cost of
one pass.  Labels, language, source and identifiers are no features.

Fit: at most ``max_train`` labelled rows, those first in a hash order of the id (where an id stands at several rows, of id
and text), by mini-batches on the driver; a row is a few kilobytes there.  Everything else is read whole and scored in blocks with the model (about 1 MB) in every task.

Defined cases: null text is empty and is scored like any text; labels other than 0 and 1 and rows without a text are not
learnt from; of repeated labels of an id each is an example; without examples of both classes every score is the
smoothed share of the ones; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import IS_SPACE, blocks, lean, runs_of, span_hashes, words
from ._common import ready

HASH_BITS = 14
STATS, BINS = 11, 12
META = (1 << HASH_BITS) + STATS * BINS  # first feature of the metadata; its last is null
WIDTH = META + BINS + 1
RANK = 8
MAX_TRAIN = 6000
STAT_SHARE = 0.5  # of a vector's squared length


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray


def _classes() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)  # symbols
    kind[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 0
    kind[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
    kind[[ord(c) for c in "0123456789"]] = 2
    kind[128:] = 3
    kind[IS_SPACE] = 4
    return kind


KIND = _classes()


def metadata(df: DataFrame) -> Column:
    """``n_chars`` of a row, null if there is none."""
    return F.col("n_chars").cast("long") if "n_chars" in df.columns else F.lit(None).cast("long")


def meta_bins(n_chars: pa.Array) -> np.ndarray:
    known = n_chars.is_valid().to_numpy(zero_copy_only=False)
    size = np.maximum(n_chars.fill_null(0).to_numpy(zero_copy_only=False).astype(float), 0)
    return META + np.where(known, np.minimum((np.log2(size + 1) / 20 * BINS).astype(np.int64), BINS - 1), BINS)


def vectors(column, n_chars) -> "list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]":
    """For each block of texts: first row, end row, row of each entry, feature, value; sorted by row and feature."""
    for lo, hi, buf, offs in blocks(column):
        n, size = hi - lo, np.diff(offs).astype(float)
        starts, ends, row = words(buf, offs)
        hashed = (span_hashes(buf, starts, ends) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        keys, counts = np.unique((row.astype(np.int64) << HASH_BITS) | hashed, return_counts=True)
        of, feature = keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)
        n_words = np.bincount(row, minlength=n).astype(float)
        value = np.sqrt(counts / n_words[of] * (1 - STAT_SHARE))
        place = np.repeat(np.arange(0, 6 * n, 6, dtype=np.int32), np.diff(offs)) + KIND[buf]
        kinds = np.bincount(place, minlength=6 * n).reshape(n, 6).T
        lines = np.diff(np.searchsorted(np.flatnonzero(buf == 10), offs))
        safe, some = np.maximum(size, 1), np.maximum(n_words, 1)
        distinct, top = np.bincount(of, minlength=n), np.zeros(n)
        np.maximum.at(top, of, counts)
        low = kinds[0] + kinds[1] + kinds[3]
        stats = np.stack(
            [
                np.log2(size + 1) / 20,
                kinds[1] / np.maximum(low, 1),
                np.minimum(1, 5 * kinds[2] / safe),
                kinds[3] / safe,
                np.minimum(1, 2 * kinds[4] / safe),
                np.minimum(1, 4 * kinds[5] / safe),
                np.minimum(1, size / some / 24),
                distinct / some,
                top / some,
                np.minimum(1, 20 * lines / some),
                np.minimum(1, low / safe),
            ]
        )
        bins = np.minimum((stats * BINS).astype(np.int64), BINS - 1) + np.arange(STATS)[:, None] * BINS + (1 << HASH_BITS)
        of = np.concatenate([of, np.tile(np.arange(n), STATS + 1)])
        feature = np.concatenate([feature, bins.ravel(), meta_bins(n_chars.slice(lo, n))])
        value = np.concatenate([value, np.full(n * (STATS + 1), np.sqrt(STAT_SHARE / (STATS + 1)))])
        order = np.argsort(of, kind="stable")
        yield lo, hi, of[order], feature[order].astype(np.int32), value[order].astype(np.float32)


def raw_scores(model: Model, at: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Scores before the sigmoid of rows with entries at[i]:at[i+1], none of them empty."""
    v = model.v[feature] * value[:, None]
    first = np.add.reduceat(model.w[feature] * value, at[:-1])
    total, squares = np.add.reduceat(v, at[:-1], axis=0), np.add.reduceat(v * v, at[:-1], axis=0)
    return model.w0 + first + 0.5 * (total * total - squares).sum(axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = RANK, epochs: int = 12, rate: float = 0.08, decay: float = 2e-5) -> Model:
    """Adagrad over mini-batches of (features, values, label); labels of both classes weigh the same half."""
    rng = np.random.default_rng(11)
    y = np.array([r[2] for r in rows], float)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(WIDTH), np.zeros((WIDTH, rank)))
    if len(set(y)) < 2:
        return model
    model.v = rng.normal(0, 0.05, (WIDTH, rank))
    g0, gw, gv = 1e-8, np.full(WIDTH, 1e-8), np.full((WIDTH, rank), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            batch = [rows[i] for i in order[k : k + 64]]
            feature, value = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch]).astype(float)
            lens = np.array([len(b[0]) for b in batch])
            at = np.concatenate([[0], np.cumsum(lens)])
            vx = model.v[feature] * value[:, None]
            total = np.add.reduceat(vx, at[:-1], axis=0)
            raw = model.w0 + np.add.reduceat(model.w[feature] * value, at[:-1]) + 0.5 * (total**2 - np.add.reduceat(vx**2, at[:-1], axis=0)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[order[k : k + 64]]) / len(batch)
            each = np.repeat(err, lens)
            used, where = np.unique(feature, return_inverse=True)
            dw = np.bincount(where, each * value) + decay * model.w[used]
            one = (each * value)[:, None] * (np.repeat(total, lens, axis=0) - vx)
            dv = np.stack([np.bincount(where, one[:, f]) for f in range(rank)], axis=1) + decay * model.v[used]
            g0 += err.sum() ** 2
            model.w0 -= rate * err.sum() / np.sqrt(g0)
            gw[used] += dw**2
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            gv[used] += dv**2
            model.v[used] -= rate * dv / np.sqrt(gv[used])
    return model


def _vector_rows(batches):
    for batch in batches:
        for lo, hi, of, feature, value in vectors(batch.column(1), batch.column(2)):
            at = runs_of(of, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(3).slice(lo, hi - lo),
                    pa.array([feature[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                    pa.array([value[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                ],
                names=["label", "place", "features", "values"],
            )


def train(df: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled rows for which ``allowed`` (over the id) holds; ``labels``: (id, label)."""
    ready(df)
    some = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
        .join(df.select(F.col(id_col).alias("_id")).where(allowed), "_id", "left_semi")
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(max_train)
    )
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), metadata(df).alias("_n_chars")).where(F.col("_text").isNotNull())
    place = F.xxhash64("_id", "_text", "_n_chars")
    rows = texts.join(F.broadcast(some), "_id").select("_label", "_text", "_n_chars", place.alias("_place"))  # at most max_train rows of two numbers
    # Ids may repeat, so the bound holds again for what the join makes.
    found = rows.mapInArrow(lean(_vector_rows), "label int, place long, features binary, values binary")
    got = found.orderBy("place", "label", "features", "values").limit(max_train).collect()
    examples = [(np.frombuffer(r.features, np.int32), np.frombuffer(r.values, np.float32), r.label) for r in got]
    return fit(sorted(examples, key=lambda e: (e[2], len(e[0]), e[0].tobytes(), e[1].tobytes())))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches):
        for batch in batches:
            for lo, hi, of, feature, value in vectors(batch.column(1), batch.column(2)):
                raw = raw_scores(model, runs_of(of, hi - lo), feature, value)
                p = 1 / (1 + np.exp(-np.clip(raw.astype(float), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p)], names=[id_col, "score"])

    model = Model(model.w0, model.w.astype(np.float32), model.v.astype(np.float32))
    return ready(df).select(id_col, text_col, metadata(df).alias("_n_chars")).mapInArrow(lean(run), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")


def keep_good(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score at least ``threshold``, unchanged."""
    columns, where = df.columns, df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo, hi, of, feature, value in vectors(batch.column(where), batch.column(len(columns))):
                raw = raw_scores(model, runs_of(of, hi - lo), feature, value)
                p = 1 / (1 + np.exp(-np.clip(raw.astype(float), -30, 30)))
                yield batch.slice(lo, hi - lo).select(columns).filter(pa.array(p >= threshold))

    model = Model(model.w0, model.w.astype(np.float32), model.v.astype(np.float32))
    return ready(df).select(*columns, metadata(df).alias("_n_chars")).mapInArrow(lean(run), df.schema)


def fold(id_col: str = "doc_id") -> Column:
    """The remainder that tells held-out rows (1) from those to learn from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def quality_scores(df: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(df, labels, fold() != 1)
    scored = score(df, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold() == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

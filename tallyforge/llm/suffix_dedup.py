"""Removal of repeated byte strings by difference-cover suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else, in the same text or another.

Distribution.  Sorting every suffix of 100 TB is out of reach; suffixes only have to meet those that they may share
LENGTH bytes with.  Each start is named by the smallest hash among the CORE-byte strings of its window, so equal
windows have equal names.  Neighbouring starts of one name form a run; its context is the bytes of all its windows.
  - A name with one run, not periodic: nothing in it repeats.
  - A name whose runs all have the same context: all of it repeats.
  - Otherwise (the ends of shared passages, edited copies, periodic text) the name's distinct contexts are text for
    suffix sorting: one of each goes, with the other contexts of its name, to one of many tasks.
  - A name with more than GROUP_BYTES of distinct contexts would be too much for a task: each start of those contexts
    is dealt by a name of its whole window, so that a hot name is spread as well.

Sorting.  A task's contexts are one text with a separator of its own after each.  Difference cover modulo 3: sort and name
the triples at places 1 and 2 mod 3, recurse on the names until they differ, sort the other suffixes by
first symbol and the rank of the next, merge by counting, and compare adjacent suffixes' LENGTH bytes.

Runs count as equal when name, context and length agree: two 64-bit hashes of different spans (the smallest core, the whole
context) and the number of bytes.

Copies of a text are judged by a key of its bytes, and every text's removed ranges come back to it by that key.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; repeated rows are texts of their own, so each
repeats the other; a null identifier is kept as it is; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import BYTE_VALUE, blocks, lean, mix64, powers, raw
from ._common import bloom_filters, cut, discard, join_hot, ready

LENGTH, CORE = 200, 50
GROUP_BYTES = 1 << 20
TASK_BYTES = 1 << 20
RUN = "name long, context long, k1 long, size int, at int, starts int, own boolean"


# ---- suffix sorting -------------------------------------------------------------------------------------------------


def _ranks(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Ranks (from 1) of the rows of several columns of whole numbers, and how many there are."""
    key = columns[0]
    for c in columns[1:]:
        key, width = np.unique(key, return_inverse=True)[1], int(c.max()) + 1
        key = key.astype(np.int64) * width + c
    values, rank = np.unique(key, return_inverse=True)
    return rank.astype(np.int64) + 1, len(values)


def _at(s: np.ndarray, places: np.ndarray) -> np.ndarray:
    """s at the places, 0 beyond its end."""
    out = np.zeros(len(places), np.int64)
    inside = places < len(s)
    out[inside] = s[places[inside]]
    return out


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffix array of s (numbers from 1)."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a place at n keeps the halves apart
    sample = np.concatenate([ones, twos])
    names, kinds = _ranks([_at(s, sample), _at(s, sample + 1), _at(s, sample + 2)])
    order = suffix_order(names) if kinds < len(sample) else np.argsort(names)
    rank_of_sample = np.empty(len(sample), np.int64)
    rank_of_sample[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = rank_of_sample
    order = sample[order]
    order = order[order < n]
    zeros = np.arange(0, n, 3)
    width = n + 4
    zero_key = s[zeros] * width + rank[zeros + 1]
    by = np.argsort(zero_key, kind="stable")
    zeros, zero_key = zeros[by], zero_key[by]
    # Merge: how many suffixes of each sampled kind come before each of the others.
    first, second = order[order % 3 == 1], order[order % 3 == 2]
    before = np.searchsorted(s[first] * width + rank[first + 1], zero_key)
    top = int(s.max()) + 1
    if top * top * width < 2**62:
        pair = lambda p: (s[p] * top + _at(s, p + 1)) * width + rank[np.minimum(p + 2, n + 2)]
        before = before + np.searchsorted(pair(second), pair(zeros))
    else:  # rank the first two symbols together
        both, _ = _ranks([np.concatenate([s[second], s[zeros]]), np.concatenate([_at(s, second + 1), _at(s, zeros + 1)])])
        k2, k0 = both[: len(second)] * width + rank[second + 2], both[len(second) :] * width + rank[np.minimum(zeros + 2, n + 2)]
        before = before + np.searchsorted(k2, k0)
    out, place = np.empty(n, np.int64), before + np.arange(len(zeros))
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = zeros
    out[rest] = order
    return out


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its starts have their ``length`` bytes elsewhere in the contexts too."""
    lens = np.array([len(c) for c in contexts], np.int64)
    at = np.cumsum(lens + 1) - lens - 1
    total = int(lens.sum()) + len(contexts)
    text, symbols = np.zeros(total + length, np.uint8), np.empty(total, np.int64)
    text_at = np.ones(total, bool)
    text_at[at + lens] = False
    body = np.frombuffer(b"".join(contexts), np.uint8)
    text[:total][text_at] = body
    symbols[text_at] = body.astype(np.int64) + len(contexts) + 1
    symbols[~text_at] = np.arange(1, len(contexts) + 1)
    order = suffix_order(symbols)
    left = np.empty(total, np.int64)  # bytes up to the separator
    left[:] = np.repeat(at + lens, lens + 1) - np.arange(total)
    order = order[left[order] >= length]
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    again = np.zeros(total, bool)
    for lo in range(0, len(order) - 1, 16384):
        a, b = order[lo : min(lo + 16384, len(order) - 1)], order[lo + 1 : lo + 16385]
        same = (view[a] == view[b]).all(axis=1)
        again[a[same]] = again[b[same]] = True
    return [again[x : x + max(0, n - length + 1)] for x, n in zip(at.tolist(), lens.tolist())]


# ---- names and runs -------------------------------------------------------------------------------------------------


def runs(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of all texts of a block: row, first start (from the text's), starts, name, context, own."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    up, down = powers(n + 1)
    np.cumsum(BYTE_VALUE[buf] * up[:n], out=sums[1:])
    span = lambda a, b: mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    none = {k: np.zeros(0, np.int64) for k in ("row", "at", "starts", "name", "context")} | {"own": np.zeros(0, bool)}
    if n < LENGTH:
        return none
    core = mix64((sums[CORE:] - sums[:-CORE]) * down[: n - CORE + 1])
    low, width = core, 1
    span_of = LENGTH - CORE + 1
    while 2 * width <= span_of:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span_of:
        low = np.minimum(low[: len(low) - (span_of - width)], low[span_of - width :])
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(low)]
    valid = np.arange(len(low)) + LENGTH <= offs[row + 1]
    same = valid[1:] & valid[:-1] & (low[1:] == low[:-1]) & (row[1:] == row[:-1])
    begin = np.flatnonzero(valid & np.concatenate([[True], ~same]))
    end = np.flatnonzero(valid & np.concatenate([~same, [True]]))  # the last start of each run
    if not len(begin):
        return none
    # A run in which the smallest core leaves a window at its front and is still the smallest can repeat itself.
    leaves = np.concatenate([[0], np.cumsum(same & (core[: len(low) - 1] == low[:-1]))])
    r = row[begin]
    return {
        "row": r,
        "at": begin - offs[r],
        "starts": end - begin + 1,
        "name": low[begin].view(np.int64),
        "context": span(begin, end + LENGTH).view(np.int64),
        "own": leaves[end] > leaves[begin],
    }


def _find_runs(batches):
    for batch in batches:
        k1, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, _, buf, offs in blocks(batch.column(2)):
            r = runs(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r["name"]), pa.array(r["context"]), pa.array(k1[lo + r["row"]]), pa.array(size[lo + r["row"]]),
                    pa.array(r["at"].astype(np.int32)), pa.array(r["starts"].astype(np.int32)), pa.array(r["own"]),
                ],
                names=["name", "context", "k1", "size", "at", "starts", "own"],
            )


def _cut_contexts(batches):
    """(name, context, bytes) of the runs listed with each text."""
    for batch in batches:
        text, offs = raw(batch.column(0))
        lists = batch.column(1)
        edge, items = np.asarray(lists.offsets), lists.values
        name, context, at, starts = (items.field(k).to_numpy() for k in ("name", "context", "at", "starts"))
        for i in range(len(lists)):
            here = slice(int(edge[i]), int(edge[i + 1]))
            a = offs[i] + at[here].astype(np.int64)
            parts = [text[x:y].tobytes() for x, y in zip(a.tolist(), (a + starts[here] + LENGTH - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[here]), pa.array(context[here]), pa.array(parts, pa.binary())], names=["name", "context", "bytes"]
            )


def _ranges(repeats: np.ndarray) -> bytes:
    """First and last+1 of the runs of True, as int32 pairs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], repeats, [False]]).astype(np.int8)))
    return edge.astype(np.int32).tobytes()


def _sort_group(key, group):
    """One task's contexts: those of a name are sorted together with all others of the task."""
    contexts = group.column("bytes").to_pylist()
    found = repeated_starts(contexts)
    return pa.table(
        {"name": group.column("name"), "context": group.column("context"), "ranges": pa.array([_ranges(f) for f in found], pa.binary())}
    )


def _windows(batches):
    """A row for each start of a context: (name, context, start, window)."""
    for batch in batches:
        for name, context, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            n = len(data) - LENGTH + 1
            for lo in range(0, n, 1 << 16):
                part = np.frombuffer(data[lo : min(lo + (1 << 16), n) + LENGTH - 1], np.uint8)
                sums = np.zeros(len(part) + 1, np.uint64)
                up, down = powers(len(part) + 1)
                np.cumsum(BYTE_VALUE[part] * up[: len(part)], out=sums[1:])
                h = mix64((sums[LENGTH:] - sums[:-LENGTH]) * down[: len(part) - LENGTH + 1])
                m = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, name)), pa.array(np.full(m, context)), pa.array(np.arange(lo, lo + m, dtype=np.int32)), pa.array(h.view(np.int64))],
                    names=["name", "context", "start", "window"],
                )


def _apply(length: int):
    def run(batches):
        for batch in batches:
            text, offs = raw(batch.column(1))
            lists = batch.column(2)
            rows = ([], [], [], [])
            for i in range(batch.num_rows):
                data = text[offs[i] : offs[i + 1]]
                gone = np.zeros(len(data) + 1, np.int32)
                some = lists[i].as_py()
                if some:
                    for at, starts, ranges in ((x["at"], x["starts"], x["ranges"]) for x in some):
                        edge = np.frombuffer(ranges, np.int32) if ranges is not None else np.array([0, starts], np.int32)
                        np.add.at(gone, at + edge[::2], 1)
                        np.add.at(gone, at + edge[1::2] + length - 1, -1)
                removed = np.cumsum(gone)[:-1] > 0
                kept = data[~removed].tobytes()
                n_spans = int((np.diff(np.concatenate([[False], removed]).astype(np.int8)) == 1).sum())
                for column, value in zip(rows, (len(data), int(removed.sum()), n_spans, kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def _ranges_by_text(texts: DataFrame) -> DataFrame:
    """(k1, size, runs): the repeated runs of each text that has any."""
    found = cut(texts.where(F.col("size") >= LENGTH).select("k1", "size", "text").mapInArrow(lean(_find_runs), RUN), "suffix-runs")
    # What each name holds; sums are combined before the shuffle.
    names = found.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"), F.min("starts").alias("least"), F.max("starts").alias("most"),
        F.max("own").alias("own"),
    )
    alike = (F.col("lo") == F.col("hi")) & (F.col("least") == F.col("most")) & (F.col("n") > 1)
    names = names.where((F.col("n") > 1) | F.col("own")).select("name", alike.alias("whole"))
    names = cut(names, "suffix-names")
    live = found.join(names, "name").select(*found.columns, "whole")
    live = cut(live, "suffix-live")
    discard(found)
    mixed = live.where(~F.col("whole"))
    contexts = (
        mixed.groupBy("name", "context")
        .agg(F.count(F.lit(1)).alias("n"), F.max("starts").alias("starts"), F.min(F.struct("k1", "size", "at")).alias("first"))
        .withColumn("bytes", F.col("starts") + LENGTH - 1)
    )
    contexts = cut(contexts, "suffix-contexts")
    groups = contexts.groupBy("name").agg(F.sum("bytes").alias("total"))
    # The bytes of one run of each context, from one of its texts.
    listed = contexts.groupBy("first.k1", "first.size").agg(
        F.collect_list(F.struct("name", "context", F.col("first.at").alias("at"), "starts")).alias("runs")
    )
    listed = cut(listed, "suffix-listed")
    one = texts.join(listed.where(F.col("size") >= LENGTH), ["k1", "size"]).dropDuplicates(["k1", "size"]).select("text", "runs")
    with bloom_filters(texts.sparkSession):  # most texts have no such run and stay out of the shuffle
        pieces = cut(one.mapInArrow(lean(_cut_contexts), "name long, context long, bytes binary"), "suffix-pieces")
    dealt = pieces.join(groups, "name")
    tasks = max(1, int((contexts.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    small = dealt.where(F.col("total") <= GROUP_BYTES).withColumn("task", F.pmod(F.xxhash64("name"), F.lit(tasks)))
    sorted_ = small.groupBy("task").applyInArrow(_sort_group, "name long, context long, ranges binary")
    windows = dealt.where(F.col("total") > GROUP_BYTES).select("name", "context", "bytes")
    windows = cut(windows.mapInArrow(lean(_windows), "name long, context long, start int, window long"), "suffix-windows")
    often = cut(windows.groupBy("name", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-often")
    total = often.agg(F.sum("n")).first()[0] or 0
    starts = join_hot(windows, often, ["name", "window"], total).groupBy("name", "context").agg(F.collect_list("start").alias("starts"))
    spread = starts.mapInArrow(_starts_to_ranges, "name long, context long, ranges binary")
    decided = sorted_.unionByName(spread)
    # A context with several runs repeats as a whole, whatever its parts do.
    decided = contexts.select("name", "context", "n").join(decided, ["name", "context"], "left").select(
        "name", "context", F.when(F.col("n") == 1, F.coalesce("ranges", F.lit(b""))).alias("ranges")
    )
    decided = cut(decided.where("ranges is null or length(ranges) > 0"), "suffix-decided")
    some = mixed.join(decided, ["name", "context"]).select("k1", "size", "at", "starts", "ranges")
    every = live.where("whole").select("k1", "size", "at", "starts", F.lit(None).cast("binary").alias("ranges"))
    both = some.unionByName(every)
    out = cut(both.groupBy("k1", "size").agg(F.collect_set(F.struct("at", "starts", "ranges")).alias("runs")), "suffix-ranges")
    discard(live, names, listed, pieces, contexts, decided, windows, often)
    return out


def _starts_to_ranges(batches):
    for batch in batches:
        out = []
        for starts in batch.column(2).to_pylist():
            flags = np.zeros(max(starts) + 1, bool)
            flags[starts] = True
            out.append(_ranges(flags))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["name", "context", "ranges"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): what is left of every row's bytes."""
    texts = ready(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "id", "text", F.xxhash64("text").alias("k1"), F.octet_length("text").alias("size")
    )
    ranges = _ranges_by_text(texts)
    kind = df.schema[id_col].dataType.simpleString()
    joined = texts.join(ranges, ["k1", "size"], "left").select("id", "text", "runs")
    return joined.mapInArrow(lean(_apply(LENGTH)), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    left = remove_repeats(df, id_col, text_col)
    return left.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""What the n-gram join sends to its buckets: whole texts, in fewer bytes than their sets of hashes, and the same sets come out."""

import numpy as np
import pyarrow as pa

from tallyforge.llm import ngram_join


def test_texts_travel_in_fewer_bytes_than_sets():
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghijé"), 6)) for _ in range(2000)]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (3, 400, 1500, 90_000)] + ["", "one two", "a b c d e a b c d e"]
    batch = pa.record_batch({"rep": pa.array(range(len(texts))), "text": pa.array(texts)})
    out = pa.Table.from_batches(ngram_join._sets([batch]))
    sizes = out.column("size").to_pylist()
    assert sum(len(x.as_py()) for column in out.columns for x in column if isinstance(x, pa.BinaryScalar)) < 0.6 * sum(sizes)
    sets = ngram_join.unpacked(out.column("text").to_pylist())
    for text, got, size in zip(texts, sets, sizes, strict=True):
        words = text.split()
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(got) == len(want) and size >= 8 * len(got) and (np.diff(got.astype(object)) > 0).all()

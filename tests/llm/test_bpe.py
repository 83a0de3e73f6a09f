"""Encoding against the tiktoken library, decoding as an exact round trip."""

import base64
import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
bpe = pytest.importorskip("tallyforge.llm.bpe")

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    parts = ["'s", "'ll", "'", "''", " ", "  ", "\n", "\t", " ", "a", "Ab", "é", "ß", "7", "٣", "²", "!", "$$", "😀", "​", "漢字", "'re", "'x", "\r\n", "　", "'v", "_"]
    yield from ["", None, " ", "\n\n x", "\n\nx", "a  ", "it's 's ''s !'s \n's", "<|endoftext|>", "x" * 3000, "word " * 50_000, " 'll'll"]
    for _ in range(400):
        yield "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))


def test_equals_the_library(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    rows += [(10_000 + r.doc_id, r.text, "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(0, "twice", None), (0, "twice", None), (None, "no id", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    full = bpe.encode(df, PATH)
    assert sorted(((r.doc_id, r.ids) for r in full.collect()), key=str) == want
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted(map(tuple, bpe.digests(df, PATH).collect()), key=str)
    assert got == sorted(
        ((i, len(x), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for i, t, _ in rows for x in [library.encode_ordinary(t or "")]), key=str
    )
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(full, PATH).where("doc_id > 0").collect()}
    assert back == {i: (t or "").encode() for i, t, _ in rows if i}
    one = next(r for r in full.collect() if r.doc_id == 6)
    assert one.starts == sorted(one.starts) and one.starts[0] == 0
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_every_code_point(spark, library):
    """Between letters, numbers and symbols; a step of code points a text, so that all are seen."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(i, "".join(f"{chr(c)}a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)}\n" for c in points[i : i + 500])) for i in range(0, len(points), 500)]
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH).collect()}
    assert [i for i, t in rows if got[i] != library.encode_ordinary(t)] == []


def test_classes_are_the_library_s():
    """Pieces, not only ids: a vocabulary in which a letter or a digit and any code point of a kind are one token."""
    for kind, lead in ((bpe.L, b"a"), (bpe.N, b"1")):
        table = bpe.codepoint_classes()
        points = [c for c in range(0x80, 0x110000) if (table[c] == kind or c % 7 == 0) and not 0xD800 <= c < 0xE000]
        ranks = {bytes([i]): i for i in range(256)}
        for c in points:
            data = lead + chr(c).encode()
            for n in range(2, len(data) + 1):
                ranks.setdefault(data[:n], len(ranks))
        enc = tiktoken.Encoding("kinds", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [c for c in points if (len(enc.encode_ordinary(lead.decode() + chr(c))) == 1) != (table[c] == kind)] == []


def test_merging_is_greedy_by_rank():
    """Against merging the lowest pair, the leftmost first, by scanning all pairs again and again."""
    rng = random.Random(9)
    for _ in range(300):
        ranks = {bytes([i]): i for i in range(256)}
        for _ in range(rng.randrange(40)):
            a, b = (rng.choice([k for k in ranks if set(k) <= set(b"abc")]) for _ in range(2))
            ranks.setdefault(a + b, len(ranks))
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 110)))
        parts = [bytes([c]) for c in piece]
        if piece in ranks:
            parts = [piece]
        while True:
            pairs = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge_pairs(piece, ranks) == [ranks[x] for x in parts]


def test_bytes_that_are_not_text(spark):
    data = [b"ok \xff\xfe \xc3\xa9\xc3", b"\xe4\xb8", b"a\x80b", "é\U0001f600".encode(), b"\xed\xa0\x80x"]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text")
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert {r.doc_id: bytes(r.bytes) for r in back} == dict(enumerate(data))
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().bytes == b""

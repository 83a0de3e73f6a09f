"""Line metrics against a character-by-character model."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dims
from tallyforge.operators import lines


def model(text, line_markers, pairs):
    """Counts by a state machine over characters."""
    rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    rows = rows[:-1] if rows and rows[-1] == "" else rows
    out = dict.fromkeys(lines.METRICS, 0) | {"physical": len(rows)}
    closing = None
    for row in rows:
        if not row.strip() and closing is None:
            out["blank"] += 1
            continue
        code = note = escaped = False
        quote, i = None, 0
        while i < len(row):
            c = row[i]
            if closing:
                note = True
                end = row.find(closing, i)
                if end < 0:
                    break
                i, closing = end + len(closing), None
            elif quote:
                code = True
                escaped, quote = (False, quote) if escaped else (c == "\\", None if c == quote else quote)
                i += 1
            elif c in "'\"`":
                code, quote, i = True, c, i + 1
            elif any(row.startswith(m, i) and (m != "REM " or i == 0 or row[i - 1].isspace()) for m in line_markers):
                note = True
                break
            elif hit := next((p for p in pairs if row.startswith(p[0], i)), None):
                note, closing, i = True, hit[1], i + len(hit[0])
            else:
                code, i = code or not c.isspace(), i + 1
        kind = "code" if code else "comment" if note else "blank" if not row.strip() else "code"
        out[kind] += 1
        out["mixed"] += code and note
    return out


SETS = {repr(m): (n, m) for n, c, _, _, m in dims.LANGUAGES if c != dims.TEXT}


@pytest.mark.parametrize("name,markers", list(SETS.values()), ids=[n for n, _ in SETS.values()])
def test_equals_the_state_machine(spark, name, markers):
    rng = random.Random(name)
    bits = [*markers[0], *(x for p in markers[1] for x in p), "'", '"', "`", "\\", "\n", "\n", "\r\n", "\r", " ", "\t", " ", "a", "b c", "é", "R", "-", "/", "REM "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(250)] + ["", "x", "\n"]
    rows = [(i, t, name, dims.SOURCE) for i, t in enumerate(texts)]
    df = lines.line_metrics(spark.createDataFrame(rows, "id int, text string, language string, category string"))
    for r in df.collect():
        want = model(texts[r.id], *markers)
        assert {m: r[m] for m in lines.METRICS} == want, texts[r.id]


def test_long_strings_do_not_overflow(spark):
    text = '"' + '\\"' * 100_000 + '" // x\n/* ' + "y\n" * 20_000
    df = spark.createDataFrame([(text, "C#", dims.SOURCE)], "text string, language string, category string")
    r = lines.line_metrics(df).first()
    assert (r.physical, r.code, r.comment, r.mixed) == (20_001, 1, 20_000, 1)


def test_documentation(spark):
    df = spark.createDataFrame([("a\n\n \t\nb\r\nc",), ("",), (None,), ("\n",)], "t string").select(lines.text_metrics(F.col("t")).alias("m")).select("m.*")
    assert [(r.physical, r.blank, r.content) for r in df.collect()] == [(5, 2, 3), (0, 0, 0), (0, 0, 0), (1, 1, 0)]


def test_bytes(spark):
    cases = [
        (b"plain", False, "plain"), (b"a\0b", True, "a\0b"), (b"\xff\xfea\0b\0", False, "ab"), (b"\xfe\xff\0a", False, "a"), (b"\xef\xbb\xbfx", False, "x"),
        (b"\xc3(", False, None), (b"\x01" + b"a" * 10, True, "\x01" + "a" * 10), (b"\x01" + b"a" * 40, False, "\x01" + "a" * 40), (b"", False, ""), (b"\t\n\x0c" * 9, True, "\t\n\x0c" * 9),
        (b"a" * 8192 + b"\0", False, "a" * 8192 + "\0"), (b"0" * 30 + b"\x10\x01", True, "0" * 30 + "\x10\x01"),
    ]
    df = spark.createDataFrame([(bytearray(c),) for c, _, _ in cases], "c binary")
    got = df.select(lines.looks_binary(F.col("c")).alias("b"), lines.decode_text(F.col("c")).alias("t")).collect()
    assert [(r.b, r.t) for r in got] == [(b, t) for _, b, t in cases]

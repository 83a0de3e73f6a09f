"""Members at the head of documents are read without the rest."""

import io
import json
import random

import pytest

from tallyforge.sources.json_head import CHUNK, top_level_member, top_level_members


def member(text, name, chunk=CHUNK):
    return top_level_member(io.BytesIO(text.encode() if isinstance(text, str) else text), name, chunk)[0]


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 4:
        return rng.choice([None, True, 1.5, -3, "", 'q"uo\\te', "é{[,:]}", "\\", "a\nb\u0000"])
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", 'k"', "é", "x:y"]): random_value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_against_the_parser(chunk):
    rng = random.Random(chunk)
    for _ in range(400):
        doc = {k: random_value(rng) for k in rng.sample(["a", "b", 'k"', "é", "x:y", "\\"], rng.randrange(6))}
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        for name in ("a", 'k"', "é", "\\", "none"):
            got = member(text, name, chunk)
            assert (got is None) == (name not in doc)
            if got is not None:
                assert json.loads(got) == doc[name]


def test_odd_documents():
    assert member('{"a": 1, "a": 2}', "a") == "1" and member('﻿ {"a":[1,{"a":2}]}', "a") == '[1,{"a":2}]'
    for text in ("", "[]", '"a"', "7", '["a", {"a": 1}]', '{"b": {"a": 1}}', '{"a": 1', '{"a": "x', '{"a', "{}", '{"x": "a:1"}'):
        assert member(text, "a") is None


def test_bytes_read_of_a_large_document(spark, tmp_path):
    path = tmp_path / "large.json"
    with path.open("w") as f:
        f.write('{"version": 3, "projects": [{"name": "n"}], "blob": "')
        for _ in range(100):
            f.write("x" * (1 << 20))
        f.write('", "last": true}')
    rows = {n: top_level_members(spark.createDataFrame([(str(path),), ("/no/file",)], "path string"), n).collect() for n in ("version", "projects", "last")}
    found = {n: {r.path: r for r in some} for n, some in rows.items()}
    assert found["version"][str(path)].value == "3" and found["version"][str(path)].bytes_read == CHUNK
    assert json.loads(found["projects"][str(path)].value) == [{"name": "n"}] and found["projects"][str(path)].bytes_read == CHUNK
    assert found["last"][str(path)].value == "true" and found["last"][str(path)].bytes_read == path.stat().st_size
    assert found["last"]["/no/file"].value is None

"""Token counts by a named byte-pair encoding whose rank file is given; nothing is guessed without one."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# How the two named encodings cut text before the merges.
PATTERNS = {
    "cl100k_base": r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s""",
    "o200k_base": "|".join(
        [
            r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?""",
            r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?""",
            r"""\p{N}{1,3}""",
            r""" ?[^\s\p{L}\p{N}]+[\r\n/]*""",
            r"""\s*[\r\n]+""",
            r"""\s+(?!\S)""",
            r"""\s+""",
        ]
    ),
}
_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str):
    """One encoder a process and rank file."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def token_count(text: Column, path: str, encoding: str | None = None, pattern: str | None = None) -> Column:
    """Tokens of each text; ``encoding`` names a known pattern, an unknown name is an error."""
    if pattern is None:
        if encoding not in PATTERNS:
            raise ValueError(f"unknown token encoding: {encoding}")
        pattern = PATTERNS[encoding]

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(path, pattern)
        return texts.map(lambda t: len(enc.encode_ordinary(t or "")))

    return count(text)

"""One top-level member of JSON documents, read no further than its end.

A document is read in chunks; what has been passed over is let go, so memory holds the member and a chunk.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame

CHUNK = 1 << 16
MARK = re.compile(rb'["{}\[\],:]')
STRING_END = re.compile(rb'["\\]')


class Reader:
    """The bytes of a file from where they are still needed."""

    def __init__(self, file: BinaryIO, chunk: int):
        self.file, self.chunk, self.data, self.read = file, chunk, bytearray(), 0

    def more(self) -> bool:
        part = self.file.read(self.chunk)
        self.data += part
        self.read += len(part)
        return bool(part)

    def find(self, pattern: re.Pattern, at: int) -> int | None:
        """Place of the next match of one byte, reading on for it."""
        while (m := pattern.search(self.data, at)) is None:
            at = max(at, len(self.data))
            if not self.more():
                return None
        return m.start()

    def after_string(self, at: int) -> int | None:
        """Place behind the quote that ends a string whose text begins at ``at``."""
        while (end := self.find(STRING_END, at)) is not None:
            if self.data[end] == 0x22:
                return end + 1
            at = end + 2
        return None


def top_level_member(file: BinaryIO, name: str, chunk: int = CHUNK) -> tuple[str | None, int]:
    """(text of the member, bytes read); the first of that name.  Null if there is none, the document is no object, or it ends before."""
    r = Reader(file, chunk)
    at = depth = 0
    begin: int | None = None  # of the member
    key: bytes | None = None
    first = True
    while (mark := r.find(MARK, at)) is not None:
        if first and (r.data[mark] != 0x7B or bytes(r.data[:mark]).strip(b" \t\r\n\xef\xbb\xbf")):
            return None, r.read
        first, c, at = False, r.data[mark : mark + 1], mark + 1
        if c == b'"':
            end = r.after_string(at)
            if end is None:
                break
            if depth == 1 and key is None:
                key = bytes(r.data[mark:end])
            at = end
        elif c in b"{[":
            depth += 1
        elif c in b"}]":
            depth -= 1
        if depth == 1 and c == b":" and begin is None and key is not None and _is(key, name):
            begin = at
        elif begin is not None and ((depth == 1 and c == b",") or depth == 0):
            return bytes(r.data[begin:mark]).decode("utf-8", "replace").strip(), r.read
        elif depth == 0:
            return None, r.read
        elif depth == 1 and c == b",":
            key = None
        if begin is None and at > chunk:
            del r.data[:at]
            at = 0
    return None, r.read


def _is(key: bytes, name: str) -> bool:
    try:
        return json.loads(key) == name
    except ValueError:
        return False


def top_level_members(files: DataFrame, name: str) -> DataFrame:
    """(path, value, bytes_read) of the documents ``files`` (path) names; value is null without the member or the file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with open(path, "rb", buffering=0) as f:
                        value, n = top_level_member(f, name)
                except OSError:
                    value, n = None, 0
                yield pd.DataFrame({"path": [path], "value": [value], "bytes_read": [n]})

    return files.select("path").mapInPandas(read, "path string, value string, bytes_read long")

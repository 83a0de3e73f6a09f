"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of codepoint classes.  A finite automaton over the classes says where pieces start.  It is run as
a scan: transition functions are elements of a finite monoid, composed by table, so the arrays are cut into columns,
the columns' functions are scanned associatively, and every column then runs from its own state, all at a time.  No
regular expression is used.  Pieces are hashed in bulk; each distinct piece goes through the pair merging (a heap of
ranks over linked pairs) once while it is in the cache.  Piece offsets are kept, and ids decode through the table of the
vocabulary's bytes.

Defined cases: null text is empty and has no ids; the vocabulary's ids are ranks and no special tokens are made; a byte
that is not UTF-8 counts as a symbol of its own and survives the round trip; null ids decode to nothing; repeated rows are
encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrays import blocks, expand, lean, span_hashes
from ._common import ready

# Classes: letter, number, other, apostrophe before a suffix of one or two letters, blank that joins what follows,
# blank before more white space, white space before a visible character, white space before more of it.
L, N, O, A1, A2, JOIN, BLANK, LAST, SPACE = range(9)
FRESH, IN_L, IN_N, IN_O, JOINED, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
N_CLASS, N_STATE = 9, 8
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that Unicode 16.0 has and Python's tables of 15.1 have not.
LETTERS_16 = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7
113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"""
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
COLUMN = 256
CACHE = 1 << 18


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[state, class] and starts[state, class]: the next state, and whether a piece starts at the character."""
    step, starts = np.zeros((N_STATE, N_CLASS), np.uint8), np.ones((N_STATE, N_CLASS), bool)
    for s in range(N_STATE):
        step[s] = [IN_L, IN_N, IN_O, ONE_LEFT, TWO_LEFT, JOINED, IN_SPACE, FRESH, IN_SPACE]
        if s in (IN_O, JOINED):  # the apostrophe belongs to the run of symbols
            step[s, A1] = step[s, A2] = IN_O
            starts[s, [O, A1, A2]] = False
    starts[JOINED, [L, N]] = starts[IN_L, L] = starts[IN_N, N] = False
    starts[IN_SPACE, [BLANK, SPACE]] = False
    step[ONE_LEFT, L], step[TWO_LEFT, L] = FRESH, ONE_LEFT
    starts[[ONE_LEFT, TWO_LEFT], L] = False
    return step, starts


STEP, STARTS = _automaton()


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that strings of (class, first of a text) induce on states: the functions, by symbol, by pair."""
    symbols = [tuple(STEP[:, c]) for c in range(N_CLASS)] + [(STEP[FRESH, c],) * N_STATE for c in range(N_CLASS)]
    found, todo = {tuple(range(N_STATE)): 0}, [tuple(range(N_STATE))]
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    funcs = np.array(list(found), np.uint8)
    pairs = np.array([[found[tuple(g[list(f)])] for g in funcs] for f in funcs], np.uint16)
    return funcs, np.array([found[tuple(s)] for s in symbols], np.uint16), pairs


FUNCS, OF_SYMBOL, PAIRS = _monoid()


def entry_states(symbols: np.ndarray) -> np.ndarray:
    """The state before each column of ``symbols`` (length x columns), the columns being one string."""
    f = OF_SYMBOL[symbols[0]]
    for row in symbols[1:]:
        f = PAIRS[f, OF_SYMBOL[row]]
    width = 1
    while width < len(f):  # associative scan over the columns' functions
        f[width:] = PAIRS[f[:-width].copy(), f[width:]]
        width *= 2
    return np.concatenate([[FRESH], FUNCS[f[:-1], FRESH]]).astype(np.uint8)


_CLASS: list[np.ndarray] = []


def codepoint_classes() -> np.ndarray:
    if not _CLASS:
        kinds = {"L": L, "N": N}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], O) for c in range(sys.maxunicode + 1)), np.uint8)
        table[WHITE] = SPACE
        for listed, kind in ((LETTERS_16, L), (NUMBERS_16, N)):
            for part in listed.split():
                first, _, last = part.partition("-")
                table[int(first, 16) : int(last or first, 16) + 1] = kind
        _CLASS.append(table)
    return _CLASS[0]


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which of the code points start a piece; ``firsts``: places where texts start."""
    n = len(points)
    cls = codepoint_classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[firsts] = begins[n] = True
    white = cls == SPACE
    more = np.ones(n, bool)  # white space or the end of the text follows
    more[:-1] = white[1:]
    more |= begins[1:]
    blank = points == 32
    cls[white & ~more & ~blank] = LAST
    cls[white & ~more & blank] = JOIN
    cls[white & more & blank] = BLANK
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        def after(k: int) -> np.ndarray:
            at = np.minimum(quotes + k, n - 1)
            inside = (quotes + k < n) & ~begins[at]
            return np.where(inside, points[at], 0)

        a, b = after(1), after(2)
        cls[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = A1
        two = np.zeros(len(quotes), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        cls[quotes[two]] = A2
    cls[firsts] += N_CLASS
    n_col = -(-n // COLUMN)
    grid = np.full(n_col * COLUMN, N_CLASS, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(n_col, COLUMN).T)
    state, out = entry_states(grid), np.empty(grid.shape, bool)
    step = np.concatenate([STEP, np.tile(STEP[FRESH], (N_STATE, 1))], axis=1).ravel()
    starts = np.concatenate([STARTS, np.ones_like(STARTS)], axis=1).ravel()
    for j, row in enumerate(grid):
        at = state.astype(np.int16) * (2 * N_CLASS) + row
        out[j] = starts[at]
        state = step[at]
    return out.T.reshape(-1)[:n]


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the neighbours of lowest rank merge, the leftmost first, until no pair has a rank.

    The heap holds (rank, start, end) of pairs; an entry whose tokens have grown meanwhile is passed over.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n))  # start of the next token and of the one before; 0: merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = after[i]
        if not middle or middle >= n or after[middle] != end:
            continue
        after[i], after[middle] = end, 0
        if end < n:
            before[end] = i
            if (r := get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        left = before[i]
        if left >= 0 and (r := get(piece[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the place of each; a byte that is not UTF-8 is a lone surrogate."""
    try:
        points = np.frombuffer(bytes(buf).decode().encode("utf-32-le"), np.uint32)
        return points, np.flatnonzero((buf & 0xC0) != 0x80)
    except UnicodeDecodeError:
        points = np.frombuffer(bytes(buf).decode(errors="surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        escaped = (points >= 0xDC80) & (points <= 0xDCFF)
        size = np.where(escaped, 1, 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
        return points, np.cumsum(size) - size


class Codec:
    """Ranks, their byte table, and a cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for piece, rank in self.ranks.items():
            by_id[rank] = piece
        self.bytes_flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.bytes_at = np.concatenate([[0], np.cumsum([len(x) for x in by_id])])
        names = [b"%d," % i for i in range(size)]
        self.names_flat = np.frombuffer(b"".join(names), np.uint8)
        self.names_at = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.at, self.used, self.count = np.empty(CACHE * 4, np.int32), np.zeros(CACHE + 2, np.int64), 0, 0

    def _merged(self, pieces: list[bytes]) -> np.ndarray:
        """Places in the cache, merging what is not there."""
        if self.count + len(pieces) > CACHE:
            self._clear()
            if len(pieces) > CACHE:
                self.at = np.zeros(len(pieces) + 2, np.int64)
        out, get = np.empty(len(pieces), np.int64), self.place.get
        for i, piece in enumerate(pieces):
            k = get(piece)
            if k is None:
                ids = merge_pairs(piece, self.ranks)
                if self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.int32)])
                self.flat[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
                k = self.place[piece] = self.count
                self.count += 1
                self.at[self.count] = self.used
            out[i] = k
        return out

    def encode(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of texts: first row, end row, ids, offsets of the texts' ids, byte offset of each id's piece in its text."""
        for lo, hi, buf, offs in blocks(column):
            if not len(buf):
                yield lo, hi, np.zeros(0, np.int32), np.zeros(hi - lo + 1, np.int64), np.zeros(0, np.int64)
                continue
            points, byte_of = code_points(buf)
            firsts = np.searchsorted(byte_of, offs[:-1][offs[:-1] < offs[1:]])
            starts = byte_of[piece_starts(points, firsts)]
            ends = np.append(starts[1:], len(buf))
            _, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
            data = bytes(buf)
            places = self._merged([data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
            ids, lens = expand(self.flat, self.at, places[which])
            upto = np.concatenate([[0], np.cumsum(lens)])
            id_offs = upto[np.searchsorted(starts, offs)]
            row = np.searchsorted(offs, starts, "right") - 1
            yield lo, hi, ids, id_offs, np.repeat(starts - offs[row], lens)

    def decode(self, ids: np.ndarray, id_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids and the offsets of the texts in them."""
        out, lens = expand(self.bytes_flat, self.bytes_at, ids)
        return out, np.concatenate([[0], np.cumsum(lens)])[id_offs]

    def listed(self, ids: np.ndarray, id_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each followed by a comma, and the offsets of the texts in them."""
        out, lens = expand(self.names_flat, self.names_at, ids)
        return out, np.concatenate([[0], np.cumsum(lens)])[id_offs]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a process and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _schema(df: DataFrame, id_col: str, rest: str) -> str:
    return f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {rest}"


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, starts): token ids and, for each, the byte offset of the piece it comes from."""

    def run(batches):
        for batch in batches:
            for lo, hi, ids, offs, starts in codec(path).encode(batch.column(1)):
                at = pa.array(offs.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(offs)),
                        pa.ListArray.from_arrays(at, pa.array(ids)),
                        pa.ListArray.from_arrays(at, pa.array(starts.astype(np.int32))),
                    ],
                    names=[id_col, "n_tokens", "ids", "starts"],
                )

    return ready(df).select(id_col, text_col).mapInArrow(lean(run), _schema(df, id_col, "n_tokens long, ids array<int>, starts array<int>"))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): what the ids stand for; null ids are none."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            offs = np.asarray(lists.offsets, np.int64)
            ids = np.asarray(lists.values)[offs[0] : offs[-1]]
            out, at = codec(path).decode(ids, offs - offs[0])
            data = out.tobytes()
            texts = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=[id_col, "bytes"])

    return ready(df).select(id_col, ids_col).mapInArrow(lean(run), _schema(df, id_col, "bytes binary"))


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), encoding and decoding in one pass."""

    def hexes(data: np.ndarray, offs: np.ndarray, less: int) -> list[str]:
        view = memoryview(np.ascontiguousarray(data))
        return [hashlib.sha256(view[a : max(a, b - less)]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]

    def run(batches):
        for batch in batches:
            c = codec(path)
            for lo, hi, ids, offs, _ in c.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(offs)),
                        pa.array(hexes(*c.listed(ids, offs), 1), pa.string()),
                        pa.array(hexes(*c.decode(ids, offs), 0), pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return ready(df).select(id_col, text_col).mapInArrow(
        lean(run), _schema(df, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    )

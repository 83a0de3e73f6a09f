"""Line metrics: code, comment, blank and content lines, without a loop over characters.

A text becomes tokens by one regular expression for each set of comment markers (line end, strings, line comments, block
comments, a run of anything else, one character).  A block comment over several lines is cut into a piece for each.  Each
piece knows its line by a running sum, and a line is what its pieces are.  Everything happens inside the row: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims

#: White space as the line rules see it: the Unicode property.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same without line ends.
WS_INLINE = r"[\t\x0B\x0C \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BREAK = r"\r\n|\r|\n"
METRICS = ["physical", "blank", "code", "comment", "mixed", "content"]


def once(value: Column, body) -> Column:
    """``body`` of a column that is computed once: Spark shares no common part inside a branch of a ``when``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ended(lines: Column) -> Column:
    """``lines`` without a last one that is empty."""
    return once(lines, lambda all_: F.when(F.element_at(all_, -1) == "", F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_))


def split_lines(text: Column) -> Column:
    """Lines without their ends; the end of a text after its last line end is no line."""
    return _ended(F.split(text, BREAK, -1))


def is_blank(line: Column) -> Column:
    return F.regexp_like(line, F.lit(rf"^{WS}*$"))


def text_metrics(text: Column) -> Column:
    """Struct of the six counts for documentation: lines are blank or content."""
    zero = F.lit(0).cast("long")

    def counts(lines: Column) -> Column:
        n, blank = F.size(lines).cast("long"), F.size(F.filter(lines, is_blank)).cast("long")
        return F.struct(n.alias("physical"), blank.alias("blank"), zero.alias("code"), zero.alias("comment"), zero.alias("mixed"), (n - blank).alias("content"))

    return once(split_lines(F.coalesce(text, F.lit(""))), counts)


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def token_pattern(line_markers: list[str], block_pairs: list[tuple[str, str]], possessive: bool = True) -> str:
    """The pattern of one set of markers, in the order in which a character is tried."""
    loop = "*+" if possessive else "*"
    parts = [BREAK]
    parts += [rf"{q}[^{q}\\\r\n]*(?:\\[^\r\n][^{q}\\\r\n]*){loop}\\?{q}?" for q in ("'", '"', "`")]
    for marker in line_markers:
        start = rf"(?<![^\s]){_quoted(marker)}" if marker.upper() == "REM " else _quoted(marker)
        parts.append(rf"{start}[^\r\n]*")
    for begin, end in block_pairs:
        parts.append(rf"{_quoted(begin)}(?s:.*?)(?:{_quoted(end)}|\z)")
    special = "".join(sorted({c for m in [*line_markers, *(b for b, _ in block_pairs)] for c in (m[0].lower(), m[0].upper())}))
    parts += [rf"[^\r\n'\"`{_quoted(special)}]+", r"(?s:.)"]
    return "(" + "|".join(parts) + ")"


def _starts_with_any(token: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.startswith(token, F.lit(m))
    return out


def code_metrics(text: Column, line_markers: list[str], block_pairs: list[tuple[str, str]]) -> Column:
    """Struct of the six counts for code with these comment markers."""
    text = F.coalesce(text, F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(token_pattern(line_markers, block_pairs)), F.lit(1))
    blocks = [b for b, _ in block_pairs]
    no, none = F.lit(False), F.array().cast("array<int>")

    # Codes: 0 line end, 1 code, 2 comment (to the end of a line, or a block without a line end), 3 white space.
    def pieces(t: Column) -> Column:
        is_string = _starts_with_any(t, ["'", '"', "`"])  # strings are tried before markers
        comment = _starts_with_any(t, line_markers) if line_markers else no
        block = _starts_with_any(t, blocks) if blocks else no
        # Each part of a block comment that has a length is a comment on its line; between the parts are line ends.
        part = lambda p, i: F.concat(F.when(i > 0, F.array(F.lit(0))).otherwise(none), F.when(p != "", F.array(F.lit(2))).otherwise(none))
        return (
            F.when(t.isin("\r\n", "\r", "\n"), F.array(F.lit(0)))
            .when(is_string, F.array(F.lit(1)))
            .when(comment, F.array(F.lit(2)))
            .when(block, F.flatten(F.transform(F.split(t, BREAK, -1), part)))
            .when(F.regexp_like(t, F.lit(rf"^{WS_INLINE}*$")), F.array(F.lit(3)))
            .otherwise(F.array(F.lit(1)))
        )

    codes = F.array_join(F.flatten(F.transform(tokens, pieces)).cast("array<string>"), "")
    has = lambda piece: lambda line: F.contains(line, F.lit(piece))

    def counts(lines: Column) -> Column:
        count = lambda test: F.size(F.filter(lines, test)).cast("long")
        n, code, mixed = F.size(lines).cast("long"), count(has("1")), count(lambda x: has("1")(x) & has("2")(x))
        comment = count(lambda x: ~has("1")(x) & has("2")(x))
        return F.struct(
            n.alias("physical"), (n - code - comment).alias("blank"), code.alias("code"), comment.alias("comment"), mixed.alias("mixed"),
            F.lit(0).cast("long").alias("content"),
        )

    # A letter a piece: lines are the parts between zeros, the last one only if it has a piece.
    return once(_ended(F.split(codes, "0", -1)), counts)


def line_metrics(df: DataFrame, text_col: str = "text", language_col: str = "language", category_col: str = "category") -> DataFrame:
    """``df`` with the six counts, by its language: one expression for each set of markers, not for each language."""
    sets: dict[str, tuple[list[str], list]] = {}
    for name, category, _, _, (line, block) in dims.LANGUAGES:
        if category != dims.TEXT:
            sets.setdefault(repr((line, block)), ([], (line, block)))[0].append(name)
    text = F.col(text_col)
    out = F.when(F.col(category_col) == dims.TEXT, text_metrics(text))
    for names, (line, block) in sets.values():
        out = out.when(F.col(language_col).isin(names), code_metrics(text, line, block))
    return df.withColumn("_m", out.otherwise(text_metrics(text))).select(*df.columns, *[F.col(f"_m.{m}").alias(m) for m in METRICS])


# ---- bytes ------------------------------------------------------------------------------------------------------------------


def looks_binary(content: Column) -> Column:
    """No text: a NUL among the first 8192 bytes, or more than a twentieth of control bytes; a UTF-16 mark is text."""
    head = F.hex(F.substring(content, 1, 8192))
    n = F.length(head) / 2
    bytes_ = lambda pattern: F.regexp_count(head, F.lit(rf"\G(?:[0-9A-F]{{2}})*?(?:{pattern})"))
    marked = F.regexp_like(head, F.lit("^(FFFE|FEFF)"))
    return ~marked & ((bytes_("00") > 0) | (bytes_("0[0-7BCEF]|1[0-9A-F]") > F.floor(n / 20)))


def decode_text(content: Column) -> Column:
    """The text by its byte order mark, else as UTF-8; null if it is neither."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda k: F.substring(content, k, 1 << 30)
    body = F.when(head == "EFBBBF", rest(4)).otherwise(content)
    utf8 = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
    return (
        F.when(F.startswith(head, F.lit("FFFE")), F.decode(rest(3), "UTF-16LE"))
        .when(F.startswith(head, F.lit("FEFF")), F.decode(rest(3), "UTF-16BE"))
        .otherwise(utf8)
    )

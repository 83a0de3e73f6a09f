"""Sinks: CSV and JSON exports, usage payloads, settings documents, report pages.

Tables are written by Spark's commit protocol.  Documents that one reader opens as a whole (an exported file, a page) are
small results that the driver writes beside the target and moves into place.
"""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

BOM = "﻿"
SCAN_COLUMNS = ["project", "path", "extension", "language", "category", "bytes", "tokens", "physical", "blank", "code", "comment", "mixed", "content"]
DAILY_COLUMNS = [
    "date", "projects", "carried", "files", "physical", "delta_physical", "code", "delta_code", "comment", "blank", "content", "tokens", "delta_tokens",
    "ai_tokens", "ai_cost", "ai_partial", "notes",
]
HISTORY_COLUMNS = [
    "project", "branch", "head", "start", "end", "mode", "scope", "status", "commits", "changed_files", "binary_files", "path", "added", "deleted",
    "modified", "net", "binary", "record_type",
]


def head(columns: list[str]) -> str:
    """The first line of an export: the engine's column names, each word with a capital."""
    return ",".join("".join(part.title() for part in c.split("_")) for c in columns)


def replace_file(path: str | os.PathLike, data: str | bytes) -> None:
    """Write beside the target, then move over it: readers see the old file or the new one."""
    path = Path(path)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)
    os.replace(name, path)


def write_files(files: DataFrame, root: str) -> None:
    """(path, content): each row a file below ``root``, a folder that driver and executors share.  Written by all tasks, a file at a time."""
    def write(rows) -> None:
        for row in rows:
            path = os.path.join(root, row.path)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            replace_file(path, bytes(row.content))

    files.select("path", "content").foreachPartition(write)


def scan_csv(files: DataFrame) -> DataFrame:
    """One ``line`` a file: four quoted texts without a formula guard, plain numbers."""
    quoted = {"project", "path", "extension", "language"}
    cells = [S.csv_cell(F.col(c)) if c in quoted else F.col(c).cast("string") for c in SCAN_COLUMNS]
    return files.select(F.concat_ws(",", *cells).alias("line"))


def _guarded(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    value = F.col(column)
    if kind == "boolean":
        value = F.when(value, "True").when(~value, "False")
    elif kind == "double":
        value = S.js_number_text(value)
    text = value.cast("string")
    return S.csv_cell(S.formula_guard(text) if kind == "string" else text)


def guarded_csv(df: DataFrame, columns: list[str]) -> DataFrame:
    """One ``line`` a row: all cells quoted, texts that a spreadsheet would run get an apostrophe; null is empty."""
    return df.select(F.concat_ws(",", *[_guarded(df, c) for c in columns]).alias("line"))


def history_csv(rows: DataFrame, branch: str, head_: str, start, end, mode: str, scope: str) -> DataFrame:
    """One ``line`` a row of ``operators.history.export_rows``, all 18 columns; ``rows`` may have columns of its own for these values."""
    given = {"branch": branch, "head": head_, "start": start, "end": end, "mode": mode, "scope": scope}
    rows = rows.withColumns({c: F.lit(v) for c, v in given.items() if c not in rows.columns})
    return guarded_csv(rows, HISTORY_COLUMNS)


def write_lines(lines: DataFrame, folder: str) -> None:
    """CSV parts without a head, written by all tasks: the form for results that no one file should hold."""
    lines.select("line").write.mode("overwrite").text(folder)


def write_csv_file(lines: DataFrame, path: str, head: str, order: list[str] | None = None) -> None:
    """One CSV file with byte order mark and CRLF for people; rows come to the driver part by part."""
    rows = (lines.orderBy(*order) if order else lines).select("line")
    replace_file(path, BOM + "".join(f"{line}\r\n" for line in [head, *(r.line for r in rows.toLocalIterator())]))


def to_json_rows(df: DataFrame) -> DataFrame:
    """One ``line`` a row, names in camel case."""
    camel = lambda c: c.split("_")[0] + "".join(p.title() for p in c.split("_")[1:])
    return df.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns])).alias("line"))


def hours_map(cube: DataFrame, key: Column, vector: list[str]) -> DataFrame:
    """One row: ``hours``, day to hour to key to a list of sums, in order."""
    def nested(entries: Column) -> Column:  # maps have no order of their own, so entries are put in order by their first field
        order = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(F.collect_list(entries), order))

    sums = F.array(*[F.col(c).cast("double") for c in vector])
    hours = cube.groupBy("day", "hour").agg(nested(F.struct(key.alias("k"), sums.alias("v"))).alias("keys"))
    days = hours.groupBy("day").agg(nested(F.struct(F.col("hour").alias("k"), F.col("keys").alias("v"))).alias("hours"))
    return days.agg(nested(F.struct(F.col("day").alias("k"), F.col("hours").alias("v"))).alias("hours"))


def write_document(document: dict, path: str) -> None:
    replace_file(path, json.dumps(document, ensure_ascii=False, indent=2))


def read_document(path: str, default: dict) -> dict:
    """A settings document; a missing one is the default, a broken one is set aside as ``.corrupt`` first."""
    try:
        with open(path, encoding="utf-8-sig") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else default
    except FileNotFoundError:
        return default
    except ValueError:
        os.replace(path, f"{path}.corrupt")
        return default


FORMAT, VERSION = "tallyforge-projects", 1


def projects_text(projects: list[dict]) -> str:
    return json.dumps({"format": FORMAT, "version": VERSION, "projects": projects}, ensure_ascii=False, indent=2)


def export_projects(projects: list[dict], path: str) -> None:
    replace_file(path, projects_text(projects))


def project_documents(projects: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``document``: one exported list a key of (name, root_path), in order of ``ord``."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "name", F.col("root_path").alias("rootPath"))))
    entries = F.transform(listed, lambda p: F.struct(p["name"].alias("name"), p["rootPath"].alias("rootPath")))
    document = F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), entries.alias("projects")))
    return projects.groupBy(*keys).agg(document.alias("document"))


def imported(documents: DataFrame, column: str) -> DataFrame:
    """``documents`` without the column, with (name, root_path, ord) of each entry of an exported document, a bare list or a settings document; entries without a folder go."""
    from ..functions import lenient_json as J

    kept = [c for c in documents.columns if c != column]
    v = documents.select(*kept, J.parse(F.col(column)).alias("v"))
    listed = F.when(J.is_array(F.col("v"), "$"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", "$.projects", "array<variant>"))
    rows = v.select(*kept, F.posexplode(listed).alias("ord", "p"))
    name, root = J.text(F.col("p"), "$.name"), J.text(F.col("p"), "$.rootPath")
    last = F.regexp_extract(F.regexp_replace(root, r"[\\/]+$", ""), r"[^\\/]+$", 0)
    return rows.where(F.trim(root) != "").select(*kept, F.when(F.trim(name) == "", last).otherwise(name).alias("name"), root.alias("root_path"), "ord")


def import_projects(spark: SparkSession, text: str) -> DataFrame:
    """(name, root_path, ord) of one document."""
    return imported(spark.createDataFrame([(text,)], "t string"), "t")


def top_level_text(df: DataFrame, column: str, name: str) -> Column:
    """One top-level property of JSON texts; nothing else is read out of them."""
    return F.get_json_object(df[column], f"$.{name}")


PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1><table>{rows}</table>
<script type="application/json" id="data">{data}</script>
"""


def report_page(title: str, payload: dict, totals: list[tuple[str, str]]) -> str:
    """A page that shows totals and carries its data."""
    esc = lambda s: "".join(f"&#{ord(c)};" if c in '&<>"' else c for c in s)
    rows = "".join(f"<tr><th>{esc(k)}<td>{esc(v)}" for k, v in totals)
    return PAGE.format(title=esc(title), rows=rows, data=json.dumps(payload, ensure_ascii=False).replace("<", "\\u003c"))

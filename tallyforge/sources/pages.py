"""Report pages: tasks write the rows of all tabs in key ranges, the commit writes one manifest of what they wrote.

A row is (tab, section, row), ``row`` a line of JSON, sorted by tab, section and keys of its own.  A page file holds at
most PAGE_ROWS rows of one tab and section, as a script that a page loads from a folder without a server.  The manifest names each
tab's files in order with their number of rows; it is swapped in as a whole, so readers see one report or the next, and
files of former reports or of lost tasks go after that.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import partial

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import ship_package
from .sinks import replace_file

PAGE_ROWS = 5000
MANIFEST, PARTS = "manifest.json", "pages"
OPEN, CLOSE = "page([\n", "\n]);\n"


@dataclass
class Page:
    tab: str
    section: str
    file: str
    rows: int


@dataclass
class Written(WriterCommitMessage):
    part: int
    pages: list[Page]


class PageWriter(DataSourceWriter):
    def __init__(self, folder: str, meta: str, page_rows: int):
        self.folder, self.meta, self.page_rows = folder, meta, page_rows

    def write(self, iterator: Iterator) -> Written:
        """A file for each run of rows of one tab and section, begun anew after ``page_rows`` rows."""
        part, attempt, pages, out = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None
        try:
            for row in iterator:
                page = pages[-1] if pages else None
                if page is None or page.rows == self.page_rows or (page.tab, page.section) != (row.tab, row.section):
                    if out is not None:
                        out.write(CLOSE)
                        out.close()
                    page = Page(row.tab, row.section, f"{attempt}-{len(pages)}.js", 0)
                    pages.append(page)
                    out = open(os.path.join(self.folder, PARTS, page.file), "w", encoding="utf-8")
                    out.write(OPEN)
                out.write(row.row if page.rows == 0 else ",\n" + row.row)
                page.rows += 1
            if out is not None:
                out.write(CLOSE)
        finally:
            if out is not None:
                out.close()
        return Written(part, pages)

    def commit(self, messages: list) -> None:
        tabs: dict = {name: {"meta": meta, "sections": {}} for name, meta in json.loads(self.meta).items()}
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            for page in message.pages:
                tab = tabs.setdefault(page.tab, {"meta": {}, "sections": {}})
                tab["sections"].setdefault(page.section, []).append({k: v for k, v in asdict(page).items() if k in ("file", "rows")})
        replace_file(os.path.join(self.folder, MANIFEST), json.dumps({"tabs": tabs}, ensure_ascii=False))
        known = {page["file"] for tab in tabs.values() for pages in tab["sections"].values() for page in pages}
        for name in os.listdir(os.path.join(self.folder, PARTS)):
            if name not in known:
                os.remove(os.path.join(self.folder, PARTS, name))

    def abort(self, messages: list) -> None:
        for message in messages:
            for page in message.pages if message is not None else []:
                os.remove(os.path.join(self.folder, PARTS, page.file))


class ReportPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_pages"

    def schema(self) -> str:
        return "tab string, section string, row string"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], self.options["meta"], int(self.options["pageRows"]))


def json_cell(c: Column) -> Column:
    """A value as JSON, whatever its type."""
    text = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def json_row(*cells: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *map(json_cell, cells)), F.lit("]"))


ORDER = ["text1", "number1", "number2", "text2"]


def section(df: DataFrame, tab: Column, name: str, row: Column, text1: Column | None = None, number1: Column | None = None, number2: Column | None = None, text2: Column | None = None) -> DataFrame:
    """Rows of one section with the keys that put them in order; sections with other keys can be united with it."""
    given = {"text1": text1, "number1": number1, "number2": number2, "text2": text2}
    keys = [(F.lit(None) if c is None else c).cast("string" if k.startswith("text") else "double").alias(k) for k, c in given.items()]
    return df.select(tab.alias("tab"), F.lit(name).alias("section"), row.alias("row"), *keys)


def write(rows: DataFrame, folder: str, meta: dict[str, dict], page_rows: int = PAGE_ROWS) -> None:
    """Publish the rows of :func:`section`, all tabs in one job.  ``meta``: what a tab's page tells besides its rows.

    ``folder`` is one that driver and executors share.  Nothing but the list of files comes to the driver.
    """
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(ReportPages)
    os.makedirs(os.path.join(folder, PARTS), exist_ok=True)
    ordered = rows.orderBy("tab", "section", *ORDER, "row").select("tab", "section", "row")
    ordered.write.format("report_pages").mode("append").options(path=folder, meta=json.dumps(meta), pageRows=page_rows).save()


def manifest(folder: str) -> dict:
    with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
        return json.load(f)["tabs"]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(tab, section, place, row) of a report, ``place`` from 0 in each tab and section."""
    listed = []
    for tab, told in manifest(folder).items():
        for name, pages in told["sections"].items():
            before = 0
            for page in pages:
                listed.append((page["file"], tab, name, before))
                before += page["rows"]
    known = spark.createDataFrame(listed, "file string, tab string, section string, before long")
    texts = spark.read.text(os.path.join(folder, PARTS), wholetext=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    lines = F.split(F.substring("value", F.lit(len(OPEN) + 1), F.length("value") - len(OPEN) - len(CLOSE)), ",\n")  # JSON rows hold no line break
    rows = texts.join(known, "file").select("tab", "section", "before", F.posexplode(lines).alias("at", "row"))
    return rows.select("tab", "section", (F.col("before") + F.col("at")).alias("place"), "row")


def streamed(folder: str, pages: list[dict]) -> Iterator[list]:
    """The rows of some pages one after another; one row is in memory."""
    for page in pages:
        with open(os.path.join(folder, PARTS, page["file"]), encoding="utf-8") as f:
            next(f)
            for line in f:
                if line.startswith("]);"):
                    break
                yield json.loads(line.rstrip("\n").rstrip(","))


def nested(rows: Iterator[list]) -> Iterator[str]:
    """Rows (day, hour, key, vector) in order as the text of one object: day to hour to key to vector."""
    day = hour = None
    yield "{"
    for d, h, key, vector in rows:
        if d != day:
            yield ("}}," if day is not None else "") + f"{json.dumps(d)}:{{"
        elif h != hour:
            yield "},"
        yield (f'"{h}":{{' if (d, h) != (day, hour) else ",") + f"{json.dumps(key, ensure_ascii=False)}:{json.dumps(vector)}"
        day, hour = d, h
    yield "}}}" if day is not None else "}"


def listed(rows: Iterator[list], flat: bool = False) -> Iterator[str]:
    yield "["
    for n, row in enumerate(rows):
        yield ("," if n else "") + json.dumps(row[0] if flat else row, ensure_ascii=False)
    yield "]"


def mapped(rows: Iterator[list]) -> Iterator[str]:
    """Rows (key, value) as the text of one object."""
    yield "{"
    for n, (key, value) in enumerate(rows):
        yield ("," if n else "") + f"{json.dumps(key, ensure_ascii=False)}:{json.dumps(value, ensure_ascii=False)}"
    yield "}"


FORMS = {"hours": nested, "rates": mapped, "appBasis": mapped, "keys": partial(listed, flat=True), "models": partial(listed, flat=True)}


def document(folder: str, tab: str, sections: list[str]) -> Iterator[str]:
    """A tab's payload as the text of one JSON document, piece by piece: what its meta tells, then the sections in this order."""
    told = manifest(folder)[tab]
    yield json.dumps(told["meta"], ensure_ascii=False)[:-1]
    for n, name in enumerate(sections):
        yield f'{", " if n or told["meta"] else ""}"{name}": '
        yield from FORMS.get(name, listed)(streamed(folder, told["sections"].get(name, [])))
    yield "}"


def escaped(text: str) -> str:
    return "".join(f"&#{ord(c)};" if c in '&<>"' else c for c in text)


HEAD = '<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1>'


def totals_table(totals: list[tuple[str, str]]) -> str:
    return "<table>" + "".join(f"<tr><th>{escaped(k)}<td>{escaped(v)}" for k, v in totals) + "</table>"


def write_page(folder: str, tab: str, name: str, title: str, totals: list[tuple[str, str]] = ()) -> None:
    """The page of a tab: totals, and its rows appended page file by page file as a reader asks for more."""
    told, up = manifest(folder)[tab], "../" * name.count("/")
    files = {s: [f"{up}{PARTS}/{p['file']}" for p in pages] for s, pages in told["sections"].items()}
    data = json.dumps({"meta": told["meta"], "files": files}, ensure_ascii=False).replace("<", "\\u003c")
    script = """<div id="rows"></div><button id="more">more</button><script>
const told = JSON.parse(document.getElementById("data").textContent), todo = Object.entries(told.files).flatMap(([s, fs]) => fs.map(f => [s, f]));
let section;
function page(rows) {
  const t = document.createElement("table");
  t.createCaption().textContent = section;
  for (const r of rows) { const tr = t.insertRow(); for (const c of r) tr.insertCell().textContent = Array.isArray(c) ? c.join(" ") : c; }
  document.getElementById("rows").append(t);
}
function more() { const next = todo.shift(); if (!next) return; section = next[0]; const s = document.createElement("script"); s.src = next[1]; document.body.append(s); }
document.getElementById("more").onclick = more; more();
</script>"""
    os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
    replace_file(os.path.join(folder, name), f'{HEAD.format(title=escaped(title))}{totals_table(totals)}<script type="application/json" id="data">{data}</script>{script}\n')


def write_dashboard(folder: str, tabs: list[tuple[str, str, str, str]]) -> None:
    """The shell: a button for each tab (id, label, address, tokens), the first one shown."""
    buttons = "\n".join(f'<button data-href="{escaped(href)}" data-id="{escaped(i)}">{escaped(label)} <span>{escaped(tokens)}</span></button>' for i, label, href, tokens in tabs)
    script = '<iframe id="view"></iframe><script>for (const b of document.querySelectorAll("button")) b.onclick = () => document.getElementById("view").src = b.dataset.href; document.querySelector("button").click();</script>'
    replace_file(os.path.join(folder, "dashboard.html"), f"{HEAD.format(title='Usage')}{buttons}{script}\n")


def write_single(folder: str, tab: str, sections: list[str], path: str, title: str, totals: list[tuple[str, str]] = ()) -> None:
    """A tab as one file to hand on.  It is written row by row by the driver, since one file has one writer."""
    def pieces():
        yield f'{HEAD.format(title=escaped(title))}{totals_table(totals)}\n<script type="application/json" id="data">'
        for piece in document(folder, tab, sections):
            yield piece.replace("<", "\\u003c")
        yield "</script>\n"

    target = f"{path}.{uuid.uuid4().hex}"
    with open(target, "w", encoding="utf-8") as f:
        f.writelines(pieces())
    os.replace(target, path)

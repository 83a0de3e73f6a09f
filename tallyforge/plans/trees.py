"""Queries that go through files: tables are written as a source tree or as an agent's home folder, which a whole run then reads.

Imported by :mod:`catalogue`, whose registries it fills.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import subprocess
import uuid
from contextlib import closing

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import dailylog, usage
from ..sources import files, registry, sinks
from . import runs
from .catalogue import _CLAUDE_PRICES, _DOC, _ROOTS, AGENT, BEST, agent_records, query, records, rounded, table


def new_folder(spark: SparkSession, label: str) -> str:
    folder = os.path.join(files.shared_folder(spark, label), uuid.uuid4().hex)
    os.makedirs(folder)
    return folder


LIMIT = 4000
_TREE = f"""{_DOC}, named AS (SELECT doc_id, doc_id % 10 AS k, lang || '/' || CASE WHEN doc_id % 10 = 1 THEN 'node_modules/' WHEN doc_id % 10 = 2 THEN 'nested' || CAST(doc_id % 3 AS VARCHAR) || '/' ELSE '' END AS folder,
  CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'b' END || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 10 = 3 THEN '.skip.md' WHEN doc_id % 10 = 4 THEN '.bin9' ELSE '.md' END AS name,
  octet_length(encode(coalesce(text, ''))) + CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END AS bytes FROM documents),
read AS (SELECT named.*, folder || name AS path, physical, blank FROM named JOIN m USING (doc_id) WHERE k NOT IN (1, 2, 3, 4)),
good AS (SELECT path, folder, bytes, physical, blank, physical - blank AS content FROM read WHERE k <> 5 AND bytes <= {LIMIT})"""


@query(f"""WITH {_TREE}
SELECT path, NULL AS warning, bytes, physical, blank, content, row_number() OVER (PARTITION BY folder ORDER BY upper(path)) AS place FROM good
UNION ALL SELECT path, 'larger than the size limit', NULL, NULL, NULL, NULL, NULL FROM read WHERE bytes > {LIMIT}
UNION ALL SELECT DISTINCT rtrim(folder, '/'), 'nested repository skipped', NULL, NULL, NULL, NULL, NULL FROM named WHERE k = 2""")
def scanned_tree(spark, sf_dir):
    """Documents as files of a project: folders that no scan enters, nested repositories, an ignore file, unknown languages, binary files, files over the limit.

    ``place``: a file's number in its folder, in the order in which the scan returns files.
    """
    root, k = new_folder(spark, "tree"), F.col("doc_id") % 10
    folder = F.concat("lang", F.lit("/"), F.when(k == 1, "node_modules/").when(k == 2, F.concat(F.lit("nested"), (F.col("doc_id") % 3).cast("string"), F.lit("/"))).otherwise(""))
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "A").otherwise("b"), F.col("doc_id").cast("string"), F.when(k == 3, ".skip.md").when(k == 4, ".bin9").otherwise(".md"))
    text = F.concat(F.when(k == 5, F.lit("\0")).otherwise(""), F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents")
    tree = docs.select(F.concat(folder, name).alias("path"), F.encode(text, "UTF-8").alias("content"))
    marks = docs.where(k == 2).select(F.concat(folder, F.lit(".git/HEAD")).alias("path"), F.lit(b"").alias("content")).distinct()
    sinks.write_files(tree.unionByName(marks), root)
    sinks.replace_file(os.path.join(root, ".gitignore"), "*.skip.md\n")
    found, warnings = runs.scan(spark, {"p": root}, "AllText", max_bytes=LIMIT)
    in_folder = Window.partitionBy(F.regexp_extract("path", "^(.*/)", 1)).orderBy("at")
    found = found.where("language = 'Markdown'").withColumn("at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(in_folder))
    shown = found.select("path", F.lit(None).cast("string").alias("warning"), "bytes", "physical", "blank", "content", "place")
    return shown.unionByName(warnings.where("path not like '%.bin9'").select("path", "warning"), allowMissingColumns=True)


@query(f"""WITH {BEST}, price(pm, ri, ro, rr, r5, r1) AS (VALUES {_CLAUDE_PRICES})
SELECT strftime(epoch_ms(ts), '%Y-%m-%d') AS day, model, sum(input) AS input, sum(cw5m + cw1h) AS cw, sum(cr) AS cr, sum(output) AS output, count(*) AS requests,
  round(sum((input * coalesce(ri, 5) + cw5m * coalesce(r5, 6.25) + cw1h * coalesce(r1, 10) + cr * coalesce(rr, 0.5) + output * coalesce(ro, 25)) / 1e6), 9) AS cost
FROM best LEFT JOIN price ON pm = model GROUP BY ALL""")
def home_usage(spark, sf_dir):
    """Events as transcripts in a home folder, a file for each thousand lines; a whole usage run finds the agent, reads the files in order of path and reports."""
    r, home = records(spark, sf_dir), new_folder(spark, "home")
    at = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    spent = F.struct(
        F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cr").alias("cache_read_input_tokens"),
        (F.col("cw5m") + F.col("cw1h")).alias("cache_creation_input_tokens"),
        F.struct(F.col("cw5m").alias("ephemeral_5m_input_tokens"), F.col("cw1h").alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
    )
    message = F.struct(F.concat(F.lit("m"), F.col("ord").cast("string")).alias("id"), "model", spent.alias("usage"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.col("session").alias("sessionId"), F.col("request").alias("requestId"), "cwd", at.alias("timestamp"), message.alias("message")))
    block = F.floor(F.col("ord") / 1000)
    name = F.concat(F.lit(".claude/projects/"), F.lpad(F.floor(block / 8).cast("string"), 12, "0"), F.lit("/"), F.lpad(block.cast("string"), 12, "0"), F.lit(".jsonl"))
    lines_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    logs = r.select("ord", line.alias("line"), name.alias("path")).groupBy("path").agg(F.encode(lines_of, "UTF-8").alias("content"))
    sinks.write_files(logs, home)
    got = runs.usage_of(spark, registry.Home.of(home))
    if got["records"] is None or got["status"]["claude"] != "Loaded":
        raise AssertionError(f"the run told {got['status']}")
    cube = usage.totals(got["cube"].where("agent = 'claude'"), "day", "model")
    return rounded(cube.select("day", "model", "input", "cw", "cr", "output", "requests", "cost"), "cost")


@query(f"""WITH {AGENT}, s AS (SELECT *, strftime(epoch_ms(ts), '%Y-%m-%d') AS date, ord AS pos, CASE WHEN session = '' THEN 'unknown' ELSE session END AS sid FROM priced), n AS (
  SELECT *, coalesce(ts >= max(ts) OVER (PARTITION BY date, agent, sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM s
), x AS (SELECT date, agent, sid, arg_max(cwd, pos) FILTER (new AND cwd <> '') AS cwd, sum(input + cw + cr + output) AS tokens, coalesce(sum(cost), 0) AS cost,
  sum(CASE WHEN cost IS NOT NULL THEN input + cw + cr + output ELSE 0 END) AS ct FROM n GROUP BY date, agent, sid),
root(project_id, r) AS (VALUES ('p0', '/d/work/p0'), ('p0sub', '/d/work/p0/sub'), ('p1', '/d/work/p1'), ('p2', '/d/work/p2'), ('none', '/d/wor')),
hit AS (SELECT x.*, arg_max(project_id, length(r)) AS project_id FROM x JOIN root ON x.cwd = r OR starts_with(x.cwd, r || '/') GROUP BY ALL)
SELECT date, project_id, sum(tokens) AS tokens, round(sum(cost), 9) AS cost, sum(ct) < sum(tokens) * 0.999 AS cost_partial FROM hit GROUP BY date, project_id""")
def daily_ai_projects(spark, sf_dir):
    """What a usage load writes into the daily log for each day and project."""
    priced = usage.with_agent_cost(usage.keep_first(agent_records(spark, sf_dir)))
    roots = spark.createDataFrame([(p, r, i) for i, (p, r) in enumerate(_ROOTS)], "project_id string, root_path string, ord int")
    return rounded(dailylog.ai_project_rows(priced, roots), "cost")


def database(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's rows as one SQLite database whose cells have the types that SQLite lets them have."""
    forms = [int, lambda i: i + 0.5, lambda i: f"{i}.25", lambda i: "x", lambda i: None, lambda i: bytes([1, i % 7])]
    cells = ((int(i), forms[i % 6](i), forms[i % 6](i)) for i in pdf["event_id"].tolist())
    with closing(sqlite3.connect(":memory:")) as db:
        db.execute("create table cells (id integer primary key, shown, amount)")
        db.executemany("insert into cells values (?, ?, ?)", cells)
        db.commit()
        return pd.DataFrame({"path": [f"{int(pdf['block'].iloc[0]):012d}.db"], "content": [db.serialize()]})


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 2 THEN CAST(event_id AS VARCHAR) || '.25' WHEN 3 THEN 'x'
  WHEN 5 THEN '1,' || CAST(event_id % 7 AS VARCHAR) END AS shown, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN event_id + 0.5 WHEN 2 THEN event_id + 0.25 WHEN 4 THEN NULL ELSE 0 END::DOUBLE AS amount FROM events""")
def sqlite_cells(spark, sf_dir):
    """Events as databases of twenty thousand rows each, read by ranges of rows; cells of any type become texts and numbers as the readers of agents' logs see them."""
    folder = new_folder(spark, "databases")
    blocks = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 20_000).alias("block"))
    sinks.write_files(blocks.groupBy("block").applyInPandas(database, "path string, content binary"), folder)
    paths = sorted(os.path.join(folder, name) for name in os.listdir(folder))
    cells = files.sqlite_table(spark, paths, "cells", "shown string, amount double", rows=5000)
    return cells.select(F.col("row").alias("event_id"), "shown", "amount")


def repository(pdf: pd.DataFrame, root: str) -> pd.DataFrame:
    """A block's orders as a repository: commits of twenty orders, a file each; every third order's file goes with the next commit."""
    name, stream, gone = f"r{int(pdf['block'].iloc[0])}", [], []
    for c, rows in pdf.sort_values("k").groupby("c", sort=True):
        stream.append(f"commit refs/heads/main\ncommitter t <t@t> {FIRST + 60 * int(c)} +0000\ndata 1\nx\n")
        stream += [f"D {path}\n" for path in gone]
        for k, path in zip(rows["k"].tolist(), rows["path"].tolist()):
            text = "".join(f"{k}-{i}\n" for i in range(k % 5 + 1))
            stream.append(f"M 100644 inline {path}\ndata {len(text)}\n{text}\n")
        gone = [path for k, path in zip(rows["k"].tolist(), rows["path"].tolist()) if k % 3 == 0]
    new = os.path.join(root, f".{name}-{uuid.uuid4().hex}")
    run = lambda *args, **more: subprocess.run(["git", *args], check=True, capture_output=True, **more)
    run("init", "-q", "--template=", "-b", "main", new)
    run("-C", new, "fast-import", "--quiet", input="".join(stream).encode(), env=os.environ | ALLOC)
    try:
        os.rename(new, os.path.join(root, name))
    except OSError:  # another attempt of this task was first
        shutil.rmtree(new)
    return pd.DataFrame({"name": [name]})


# Git's import frees and maps its buffers anew for each tree, a third of its time, unless the allocator keeps them.
ALLOC = {"MALLOC_MMAP_THRESHOLD_": str(64 << 20), "MALLOC_TRIM_THRESHOLD_": str(256 << 20)}
FIRST = 1_700_000_000
WITHIN = (10, 80)
_PATH = "CASE WHEN o_orderkey % 7 = 0 THEN 'f' || {key} || '.bin9' ELSE 'src/f' || {key} || '.py' END"


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey // 4000 AS block, (o_orderkey % 4000) // 20 AS c, {_PATH.format(key="CAST(o_orderkey AS VARCHAR)")} AS path, o_orderkey % 5 + 1 AS n FROM orders),
follows AS (SELECT block, c, lead(c) OVER (PARTITION BY block ORDER BY c) AS d FROM (SELECT DISTINCT block, c FROM o)),
x AS (SELECT block, path, CASE WHEN c BETWEEN {WITHIN[0]} AND {WITHIN[1]} THEN n ELSE 0 END AS added, CASE WHEN k % 3 = 0 AND d BETWEEN {WITHIN[0]} AND {WITHIN[1]} THEN n ELSE 0 END AS deleted FROM o JOIN follows USING (block, c) WHERE k % 7 <> 0)
SELECT 'r' || CAST(block AS VARCHAR) AS project_id, path, added, deleted, 0 AS modified, false AS "binary" FROM x WHERE added + deleted > 0""")
def repository_history(spark, sf_dir):
    """Orders as repositories of four thousand files each, whose history over a window a whole run reports; paths of no known language do not count."""
    root, key = new_folder(spark, "repositories"), F.col("o_orderkey")
    path = F.expr(_PATH.format(key="CAST(o_orderkey AS STRING)"))
    orders = table(spark, sf_dir, "orders").select(key.alias("k"), F.floor(key / 4000).alias("block"), F.floor(key % 4000 / 20).alias("c"), path.alias("path"))
    orders.groupBy("block").applyInPandas(lambda pdf: repository(pdf, root), "name string").count()
    repos = {name: os.path.join(root, name) for name in sorted(os.listdir(root)) if not name.startswith(".")}
    report = runs.history_report(spark, repos, FIRST + 60 * WITHIN[0], FIRST + 60 * WITHIN[1])
    return report["files"].select("project_id", "path", "added", "deleted", "modified", "binary")

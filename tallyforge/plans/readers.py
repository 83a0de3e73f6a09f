"""Queries over agents' logs, exports and scalar functions: logs are spelled out from ``events`` and read back.

Imported by :mod:`catalogue`, whose registries it fills.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lenient_json as J
from ..functions import scalars as S
from ..operators import dailylog, history, lines, metrics, paths, usage
from ..sources import agents, files, pages, sinks
from . import reports
from .catalogue import ACUBE_DAY, AGENT, HIST, ORACLES, REC, SCAN, agent_records, ai_days, day_lines, history_rows, priced_cube, query, records, rounded, table, timeline_sql

AT = "strftime(epoch_ms(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def at() -> Column:
    return F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def every(n: int, value, other=None) -> Column:
    """``value`` where ``ord`` divides by n, else ``other``."""
    return F.when(F.col("ord") % n == 0, value).otherwise(F.lit(None) if other is None else other)


def joined(df: DataFrame, key: str, item: Column) -> DataFrame:
    """(key, items): one list a key in order of ``ord``, a file's entries."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("i")))), lambda x: x["i"]).alias("items"))


# ---- agents' logs -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {REC} SELECT ts, model, input, CASE WHEN ord % 7 <> 0 THEN cw5m WHEN cw5m + cw1h = 0 THEN 5 ELSE cw5m + 5 END AS cw5m, cw1h, cr, output, thinking,
  session, CASE WHEN request = '' THEN 'm' || CAST(ord AS VARCHAR) ELSE request END AS request, cwd, branch, ord FROM rec WHERE ord % 50 <> 0 AND ord % 51 <> 0 AND ord % 53 <> 0""")
def transcript_lines(spark, sf_dir):
    """Broken lines, other types and models in brackets are left out; a cache total that its parts do not add up to is repaired."""
    r = records(spark, sf_dir)
    model = every(53, F.lit("<synthetic>"), F.concat("model", F.lit("-20260101")))
    spent = F.struct(
        F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cr").alias("cache_read_input_tokens"),
        (F.col("cw5m") + F.col("cw1h") + every(7, 5, 0)).alias("cache_creation_input_tokens"),
        F.struct(F.col("cw5m").alias("ephemeral_5m_input_tokens"), F.col("cw1h").alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
        F.struct(F.col("thinking").alias("thinking_tokens")).alias("output_tokens_details"),
    )
    message = F.struct(F.concat(F.lit("m"), F.col("ord").cast("string")).alias("id"), model.alias("model"), spent.alias("usage"))
    whole = F.to_json(F.struct(
        every(51, F.lit("user"), F.lit("assistant")).alias("type"), F.col("session").alias("sessionId"), F.col("request").alias("requestId"),
        "cwd", F.col("branch").alias("gitBranch"), at().alias("timestamp"), message.alias("message"),
    ))
    return agents.transcript_records(r.select(every(50, F.left(whole, F.length(whole) - 3), whole).alias("line"), "ord"))


_CODEX = f"""{REC}, lines AS (SELECT *, ord % 10 AS k, {AT} AS said FROM rec), told AS (
  SELECT *, coalesce(first_value(CASE WHEN k = 1 THEN 'S' || session END IGNORE NULLS) OVER w, '') AS sid,
    coalesce(last_value(CASE WHEN k = 0 AND cwd <> '' THEN cwd END IGNORE NULLS) OVER w, first_value(CASE WHEN k = 1 THEN '/meta' || branch END IGNORE NULLS) OVER w, '') AS folder,
    coalesce(last_value(CASE WHEN k = 0 THEN model END IGNORE NULLS) OVER w, 'unknown') AS m
  FROM lines WINDOW w AS (PARTITION BY session ORDER BY ord ROWS UNBOUNDED PRECEDING)
), counts AS (SELECT *, lag(input, 1, -1) OVER (PARTITION BY session ORDER BY ord) AS prev FROM told WHERE k > 1)"""


@query(f"""WITH {_CODEX} SELECT 'codex' AS agent, ts, m AS model, CAST(greatest(0, input - cr) AS DOUBLE) AS input, CAST(cw5m AS DOUBLE) AS cw, CAST(cr AS DOUBLE) AS cr,
  CAST(output AS DOUBLE) AS output, CAST(thinking AS DOUBLE) AS thinking, CAST(NULL AS DOUBLE) AS cost, sid AS session, 'codex:' || said || ':' || CAST(input AS VARCHAR) AS request,
  folder AS cwd, 1 AS calls, ord FROM counts WHERE input <> prev""")
def codex_rollouts(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("at", at())
    turn = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct("model", "cwd").alias("payload")))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("S"), "session").alias("id"), F.concat(F.lit("/meta"), "branch").alias("cwd")).alias("payload")))
    last = F.struct(
        F.col("input").alias("input_tokens"), F.col("cw5m").alias("cache_write_input_tokens"), F.col("cr").alias("cached_input_tokens"),
        F.col("output").alias("output_tokens"), F.col("thinking").alias("reasoning_output_tokens"),
    )
    info = F.struct(F.struct(F.col("input").alias("total_tokens")).alias("total_token_usage"), last.alias("last_token_usage"))
    count = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.col("at").alias("timestamp"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload")))
    line = F.when(F.col("ord") % 10 == 0, turn).when(F.col("ord") % 10 == 1, meta).otherwise(count)
    return agents.codex_records(r.select(F.col("session").alias("path"), "ord", line.alias("line")))


_FILE = "e.user_id * 4294967296"
_BY_USER = f"{REC}, e AS (SELECT rec.*, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ord) - 1 AS n FROM rec JOIN events ON event_id = ord)"


def by_user(spark, sf_dir) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), "user_id")
    return records(spark, sf_dir).join(users, "ord")


@query(f"""WITH {_BY_USER} SELECT 'cline' AS agent, CASE WHEN ord % 9 = 0 THEN 9000 ELSE ts END AS ts, CASE WHEN ord % 6 = 0 THEN 'hm' ELSE model END AS model,
  CAST(greatest(0, input - cr - cw5m) AS DOUBLE) AS input, CAST(cw5m AS DOUBLE) AS cw, CAST(cr AS DOUBLE) AS cr, CAST(output AS DOUBLE) AS output, 0.0::DOUBLE AS thinking,
  CASE WHEN ord % 3 = 0 THEN (ord % 7) * 0.5::DOUBLE END AS cost, 'd' || CAST(user_id AS VARCHAR) AS session,
  'cline:' || CASE WHEN ord % 5 <> 0 THEN 'q' || CAST(ord AS VARCHAR) WHEN ord % 9 = 0 THEN '0' ELSE CAST(ts AS VARCHAR) END AS request,
  '/w' || CAST(user_id AS VARCHAR) AS cwd, 1 AS calls, {_FILE} + n AS ord FROM e WHERE ord % 4 <> 0 AND (input <> 0 OR output <> 0)""")
def cline_tasks(spark, sf_dir):
    r = by_user(spark, sf_dir)
    spent = F.struct(
        F.col("input").alias("inputTokens"), F.col("output").alias("outputTokens"), F.col("cr").alias("cacheReadTokens"), F.col("cw5m").alias("cacheWriteTokens"),
        every(3, (F.col("ord") % 7) * 0.5).alias("cost"),
    )
    message = F.struct(
        F.when(F.col("ord") % 5 != 0, F.concat(F.lit("q"), F.col("ord").cast("string"))).alias("id"), every(4, F.lit("user"), F.lit("assistant")).alias("role"),
        every(9, F.lit(0), F.col("ts")).alias("ts"), F.struct(every(6, F.lit(""), F.col("model")).alias("id")).alias("modelInfo"), spent.alias("metrics"),
    )
    files = joined(r, "user_id", message)
    folder, first = F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("dir"), F.shiftleft("user_id", 32).alias("ord")
    head = F.to_json(F.struct(F.lit("hm").alias("model"), F.lit("1970-01-01T00:00:09Z").alias("started_at"), F.concat(F.lit("/w"), F.col("user_id").cast("string")).alias("cwd")))
    messages = files.select(folder, first, F.to_json(F.struct(F.col("items").alias("messages"))).alias("content"))
    return agents.cline_records(messages, files.select(folder, first, head.alias("content")))


@query(f"""WITH {_BY_USER} SELECT 'lmstudio' AS agent, CASE WHEN ord % 4 = 0 THEN 7 ELSE ts END AS ts, CASE WHEN ord % 6 = 0 THEN 'last' ELSE model END AS model,
  CAST(input + CASE WHEN ord % 3 = 1 THEN 1000 ELSE 0 END AS DOUBLE) AS input, 0.0::DOUBLE AS cw, 0.0::DOUBLE AS cr, CAST(output AS DOUBLE) AS output, 0.0::DOUBLE AS thinking, 0.0::DOUBLE AS cost,
  't' || CAST(user_id AS VARCHAR) AS session, 'lmstudio:' || CASE WHEN ord % 4 = 0 THEN 'x' ELSE CAST(ts AS VARCHAR) END || '-' || CAST(ord AS VARCHAR) AS request,
  '' AS cwd, 1 AS calls, {_FILE} + n * 65536 AS ord FROM e WHERE ord % 5 <> 0""")
def lmstudio_talks(spark, sf_dir):
    """Only the version that was kept counts, or the first where the choice is out of range."""
    r = by_user(spark, sf_dir)
    name = F.concat(every(4, F.lit("x"), F.col("ts").cast("string")), F.lit("-"), F.col("ord").cast("string"))

    def version(more: int) -> Column:
        stats = F.struct((F.col("input") + more).alias("promptTokensCount"), F.col("output").alias("predictedTokensCount"))
        step = F.struct(name.alias("stepIdentifier"), F.struct(every(6, F.lit(""), F.col("model")).alias("identifier"), stats.alias("stats")).alias("genInfo"))
        return F.struct(every(5, F.lit("user"), F.lit("assistant")).alias("role"), F.array(step).alias("steps"))

    files = joined(r, "user_id", F.struct((F.col("ord") % 3).alias("currentlySelected"), F.array(version(0), version(1000)).alias("versions")))
    talk = F.to_json(F.struct(F.lit(7).alias("createdAt"), F.struct(F.lit("last").alias("identifier")).alias("lastUsedModel"), F.col("items").alias("messages")))
    user = F.col("user_id").cast("string")
    return agents.lmstudio_records(files.select(F.concat(F.lit("t"), user, F.lit(".conversation.json")).alias("name"), F.shiftleft("user_id", 32).alias("ord"), talk.alias("content")))


_SESSION = "s AS (SELECT DISTINCT session AS id, '/d/' || session AS directory FROM rec WHERE ord % 4 <> 0 AND length(session) <> 3)"


def sessions(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).where("ord % 4 <> 0 and length(session) <> 3").select(F.lit("db").alias("path"), F.col("session").alias("id"), F.concat(F.lit("/d/"), "session").alias("directory")).distinct()


@query(f"""WITH {REC}, {_SESSION} SELECT 'zcode' AS agent, ts, CASE WHEN ord % 13 = 0 THEN 'unknown' ELSE model END AS model, CAST(greatest(0, input - cr - cw5m) AS DOUBLE) AS input,
  CAST(cw5m AS DOUBLE) AS cw, CAST(cr AS DOUBLE) AS cr, CASE WHEN ord % 17 = 0 THEN 0.0 ELSE CAST(output AS DOUBLE) END AS output, CAST(thinking AS DOUBLE) AS thinking, CAST(NULL AS DOUBLE) AS cost,
  session, 'u' || CAST(ord AS VARCHAR) AS request, coalesce(directory, '') AS cwd, 1 AS calls, ord FROM rec LEFT JOIN s ON s.id = session
  WHERE input > 0 OR (output > 0 AND ord % 17 <> 0)""")
def zcode_usage(spark, sf_dir):
    r = records(spark, sf_dir)
    d = lambda c: F.col(c).cast("double")
    rows = r.select(
        F.lit("db").alias("path"), F.col("ord").alias("row"), F.concat(F.lit("u"), F.col("ord").cast("string")).alias("id"), F.col("session").alias("session_id"),
        every(13, F.lit(None), F.col("model")).alias("model_id"), d("ts").alias("started_at"), d("input").alias("input_tokens"),
        F.when(F.col("ord") % 17 != 0, d("output")).alias("output_tokens"), d("thinking").alias("reasoning_tokens"), d("cw5m").alias("cache_creation_input_tokens"), d("cr").alias("cache_read_input_tokens"),
    )
    return agents.zcode_records(rows, sessions(spark, sf_dir))


@query(f"""WITH {REC}, {_SESSION} SELECT 'opencode' AS agent, CASE WHEN ord % 9 = 0 THEN 5 ELSE ts END AS ts, CASE WHEN ord % 6 = 0 THEN 'm:FREE' ELSE model END AS model, CAST(input AS DOUBLE) AS input,
  CAST(cw5m AS DOUBLE) AS cw, CAST(cr AS DOUBLE) AS cr, CAST(output + thinking AS DOUBLE) AS output, CAST(thinking AS DOUBLE) AS thinking,
  CASE WHEN ord % 3 > 0 THEN (ord % 3) * 0.25::DOUBLE WHEN ord % 6 = 0 THEN 0.0 END AS cost, session, 'u' || CAST(ord AS VARCHAR) AS request,
  CASE WHEN cwd <> '' THEN cwd ELSE coalesce(directory, '') END AS cwd, 1 AS calls, ord FROM rec LEFT JOIN s ON s.id = session
  WHERE ord % 8 <> 0 AND ord % 50 <> 1 AND (input <> 0 OR output <> 0 OR thinking <> 0 OR cr <> 0 OR cw5m <> 0 OR ord % 3 > 0)""")
def opencode_messages(spark, sf_dir):
    r = records(spark, sf_dir)
    tokens = F.struct("input", "output", F.col("thinking").alias("reasoning"), F.struct(F.col("cr").alias("read"), F.col("cw5m").alias("write")).alias("cache"))
    data = F.to_json(F.struct(
        every(8, F.lit("user"), F.lit("assistant")).alias("role"), every(6, F.lit("m:FREE"), F.col("model")).alias("modelID"), tokens.alias("tokens"),
        ((F.col("ord") % 3) * 0.25).alias("cost"), F.struct(every(9, F.lit(None), F.col("ts")).alias("created")).alias("time"), F.struct("cwd").alias("path"),
    ))
    rows = r.select(
        F.lit("db").alias("path"), F.col("ord").alias("row"), F.concat(F.lit("u"), F.col("ord").cast("string")).alias("id"), F.col("session").alias("session_id"), F.lit(5.0).alias("time_created"),
        F.when(F.col("ord") % 50 == 1, F.left(data, F.length(data) - 1)).otherwise(data).alias("data"),
    )
    return agents.opencode_records(rows, sessions(spark, sf_dir))


@query(f"""WITH {REC} SELECT 'hermes' AS agent, ts, model, CAST(input AS DOUBLE) AS input, CAST(cw5m AS DOUBLE) AS cw, CAST(cr AS DOUBLE) AS cr, CAST(output AS DOUBLE) AS output,
  CAST(thinking AS DOUBLE) AS thinking, CASE WHEN ord % 3 = 0 THEN 0.0 WHEN ord % 4 > 0 THEN (ord % 4) * 0.5::DOUBLE END AS cost, 's' || CAST(ord AS VARCHAR) AS session,
  'hermes:s' || CAST(ord AS VARCHAR) AS request, cwd, CAST(greatest(1, ord % 5) AS INTEGER) AS calls, ord FROM rec WHERE input <> 0 OR output <> 0""")
def hermes_sessions(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    rows = records(spark, sf_dir).select(
        F.col("ord").alias("row"), F.concat(F.lit("s"), F.col("ord").cast("string")).alias("id"), "model", "cwd", (d("ts") / 1000).alias("started_at"), d("input").alias("input_tokens"),
        d("output").alias("output_tokens"), d("cr").alias("cache_read_tokens"), d("cw5m").alias("cache_write_tokens"), d("thinking").alias("reasoning_tokens"),
        every(3, F.lit(0.0)).alias("actual_cost_usd"), ((F.col("ord") % 4) * 0.5).alias("estimated_cost_usd"), (F.col("ord") % 5).cast("double").alias("api_call_count"),
    )
    return agents.hermes_records(rows)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(**fields) -> bytes:
    """A protobuf message; f7=5 is field 7 with a number, text and bytes are length-delimited."""
    out = b""
    for name, value in fields.items():
        number, data = int(name[1:]), value.encode() if isinstance(value, str) else value
        out += _varint(number << 3) + _varint(data) if isinstance(data, int) else _varint(number << 3 | 2) + _varint(len(data)) + data
    return out


def _steps(df: pd.DataFrame) -> pd.Series:
    def one(ord_, ts, number, spent_in, spent_out, cw, cr, thinking, request) -> bytes:
        when = _message(f1=ts // 1000, f2=ts % 1000 * 1_000_000)
        if ord_ % 20 == 0:
            return _message(f1=when)
        return _message(f1=when, f3="else", f9=_message(f1=number, f2=spent_in, f3=spent_out, f4=cw, f5=cr, f9=thinking, f11=request))

    columns = [df[c].astype("int64").tolist() for c in ("ord", "ts", "number", "input", "output", "cw5m", "cr", "thinking")]
    return pd.Series([one(*r) for r in zip(*columns, df["request"].tolist())], dtype=object)


def _named(df: pd.DataFrame) -> pd.Series:
    return pd.Series([_message(f1=_message(f4=_message(f1=int(n)), f19=m)) for n, m in zip(df["number"], df["model"])], dtype=object)


@query(f"""WITH {REC}, r AS (SELECT *, CAST(floor(ord / 7) AS BIGINT) % 5 + 1 AS number FROM rec),
own AS (SELECT session, number, arg_max(model, ord) AS name FROM r WHERE ord % 3 = 0 AND number < 5 GROUP BY ALL), any_ AS (SELECT number, arg_min(name, session) AS name FROM own GROUP BY number)
SELECT 'antigravity' AS agent, ts, coalesce(own.name, any_.name, 'unnamed model #' || CAST(number AS VARCHAR)) AS model, CAST(input AS DOUBLE) AS input, CAST(cw5m AS DOUBLE) AS cw, CAST(cr AS DOUBLE) AS cr,
  CAST(output AS DOUBLE) AS output, CAST(thinking AS DOUBLE) AS thinking, CAST(NULL AS DOUBLE) AS cost, session, CASE WHEN request = '' THEN session || ':' || CAST(ord AS VARCHAR) ELSE request END AS request,
  'c:\\w\\' || session AS cwd, 1 AS calls, ord FROM r LEFT JOIN own USING (session, number) LEFT JOIN any_ USING (number) WHERE ord % 20 <> 0""")
def antigravity_steps(spark, sf_dir):
    """Conversation databases with protobuf blobs: times, usage and names of models."""
    r = records(spark, sf_dir).withColumn("number", F.floor(F.col("ord") / 7) % 5 + 1)
    r = r.withColumns({"path": F.concat(F.lit("/x/"), "session", F.lit(".db")), "row": F.col("ord"), "idx": F.col("ord").cast("string")})
    blob = F.pandas_udf(_steps, "binary")(F.struct("ord", "ts", "number", "input", "output", "cw5m", "cr", "thinking", "request"))
    names = r.where("ord % 3 = 0 and number < 5").select("path", "row", F.pandas_udf(_named, "binary")(F.struct("number", "model")).alias("data"))
    uri = F.pandas_udf(lambda s: s.map(lambda x: _message(f1=_message(f1=x))), "binary")
    places = r.groupBy("path").agg(F.min("row").alias("row"), F.min("session").alias("session"))
    places = places.select("path", "row", uri(F.concat(F.lit("file:///c%3A/w/"), "session")).alias("data"))
    return agents.antigravity_records(r.select("path", "row", "idx", blob.alias("metadata")), names, places)


@query("""WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role = 'user')
SELECT 'copilot' AS agent, 1000 + turn AS ts, CASE WHEN i % 3 = 0 THEN 'picked' ELSE 'gpt-' || CAST(conv_id % 4 AS VARCHAR) END AS model, CAST(length(text) AS DOUBLE) AS input, 0.0::DOUBLE AS cw, 0.0::DOUBLE AS cr,
  CAST(turn + 7 AS DOUBLE) AS output, 0.0::DOUBLE AS thinking, CAST(NULL AS DOUBLE) AS cost, 'c' || CAST(conv_id AS VARCHAR) AS session,
  CASE WHEN i % 2 = 0 THEN 'r' || CAST(turn AS VARCHAR) ELSE 'c' || CAST(conv_id AS VARCHAR) || ':' || CAST(i AS VARCHAR) END AS request,
  'd:\\p' || CAST(conv_id % 5 AS VARCHAR) AS cwd, CAST(CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS calls, conv_id * 65536 + i AS ord FROM u""")
def copilot_patch_logs(spark, sf_dir):
    """Each conversation is a log of patches: a document, requests spliced into its list, and values set in them, some twice."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    c = c.withColumn("i", number)
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    request = F.struct(
        F.when(F.col("i") % 2 == 0, F.concat(F.lit("r"), F.col("turn").cast("string"))).alias("requestId"), (F.col("turn") + 1000).alias("timestamp"),
        F.when(F.col("i") % 3 != 0, F.concat(F.lit("copilot/gpt-"), (F.col("conv_id") % 4).cast("string"))).alias("modelId"), F.length("text").alias("promptTokens"),
        F.struct(F.struct(F.when(F.col("i") % 2 == 0, F.array(F.lit(1), F.lit(2))).alias("toolCallRounds")).alias("metadata")).alias("result"),
    )
    push = F.to_json(F.struct(F.lit(2).alias("kind"), F.array(F.lit("requests")).alias("k"), F.array(request).alias("v")))

    def put(value: Column) -> Column:  # a path holds text and numbers, so it is spelled out
        return F.concat(F.lit('{"kind":1,"k":["requests",'), F.col("i").cast("string"), F.lit(',"completionTokens"],"v":'), value.cast("string"), F.lit("}"))

    patches = F.concat_ws("\n", push, put(F.col("turn") + 7), put(F.col("turn")))
    files = joined(c.withColumnRenamed("turn", "ord").withColumn("turn", F.col("ord")), "conv_id", patches)
    start = F.concat(F.lit('{"kind":0,"v":{"sessionId":"c'), F.col("conv_id").cast("string"), F.lit('","inputState":{"selectedModel":{"identifier":"picked"}},"requests":[]}}\nnot a patch\n'))
    folder = F.concat(F.lit("w"), (F.col("conv_id") % 5).cast("string"))
    logs = files.select(folder.alias("dir"), F.concat(name, F.lit(".jsonl")).alias("name"), (F.col("conv_id") * 65536).alias("ord"), F.concat(start, F.array_join("items", "\n")).alias("content"))
    where = files.select((F.col("conv_id") % 5).alias("k")).distinct()
    return agents.copilot_records(logs, where.select(F.concat(F.lit("w"), F.col("k").cast("string")).alias("dir"), F.to_json(F.struct(F.concat(F.lit("file:///d%3A/p"), F.col("k").cast("string")).alias("folder"))).alias("content")))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) + 1 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
s AS (SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS n, CAST([] AS STRUCT(turn BIGINT, size BIGINT)[]) AS st FROM c
  UNION ALL SELECT s.conv_id, c.n, list_append(CASE WHEN c.n % 4 = 1 THEN list_slice(st, 1, c.n // 2) WHEN c.n % 4 = 3 THEN list_slice(st, 1, len(st) - 1) ELSE st END, {'turn': CAST(c.turn AS BIGINT), 'size': CAST(c.size AS BIGINT)})
  FROM s JOIN c ON c.conv_id = s.conv_id AND c.n = s.n + 1),
l AS (SELECT conv_id, arg_max(st, n) AS st FROM s GROUP BY conv_id), e AS (SELECT conv_id, unnest(st) AS x, unnest(range(len(st))) AS i FROM l)
SELECT 'c' || CAST(conv_id AS VARCHAR) AS session, 'r' || CAST(x.turn AS VARCHAR) AS request, CAST(x.size AS DOUBLE) AS input, conv_id * 65536 + i AS ord FROM e""")
def patch_splices(spark, sf_dir):
    """Each conversation is a log of requests put into a list at a place: what stands from there on goes, and places count from either end."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    request = F.struct(F.concat(F.lit("r"), F.col("turn").cast("string")).alias("requestId"), (F.col("turn") + 1000).alias("timestamp"), F.lit("m").alias("modelId"), (F.length("text") + 1).alias("promptTokens"))
    place = F.when(F.col("n") % 4 == 1, F.floor(F.col("n") / 2)).when(F.col("n") % 4 == 3, F.lit(-1))
    patch = F.to_json(F.struct(F.lit(2).alias("kind"), F.array(F.lit("requests")).alias("k"), place.alias("i"), request.alias("v")))
    files = joined(c.withColumnRenamed("n", "ord").withColumn("n", F.col("ord")), "conv_id", patch)
    start = F.concat(F.lit('{"kind":0,"v":{"sessionId":"c'), F.col("conv_id").cast("string"), F.lit('","requests":[]}}\n'))
    logs = files.select(F.lit("w").alias("dir"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("name"), (F.col("conv_id") * 65536).alias("ord"), F.concat(start, F.array_join("items", "\n")).alias("content"))
    return agents.copilot_records(logs, logs.select("dir", F.lit("{}").alias("content")).limit(0)).select("session", "request", "input", "ord")


# ---- payloads, exports --------------------------------------------------------------------------------------------------------


@query(f"""WITH {AGENT} SELECT '{{"project":"p' || CAST(ord % 7 AS VARCHAR) || '","topModel":"' || model || '","cacheReadTokens":' || CAST(CAST(cr AS BIGINT) AS VARCHAR) || '}}' AS line FROM agent""")
def json_export(spark, sf_dir):
    r = agent_records(spark, sf_dir)
    return sinks.to_json_rows(r.select(F.concat(F.lit("p"), (F.col("ord") % 7).cast("string")).alias("project"), F.col("model").alias("top_model"), F.col("cr").cast("long").alias("cache_read_tokens")))


@query("""SELECT '"=p' || CAST(doc_id % 5 AS VARCHAR) || '","src/""' || CAST(doc_id AS VARCHAR) || '"".cs",".cs","' || lang || '",SourceCode,' || CAST(n_chars AS VARCHAR) || ',0,1,2,3,4,5,6' AS line FROM documents""")
def scan_csv_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.concat(F.lit("=p"), (F.col("doc_id") % 5).cast("string")).alias("project"), F.concat(F.lit('src/"'), F.col("doc_id").cast("string"), F.lit('".cs')).alias("path"), F.lit(".cs").alias("extension"),
        F.col("lang").alias("language"), F.lit("SourceCode").alias("category"), F.col("n_chars").alias("bytes"), *[F.lit(i).alias(c) for i, c in enumerate(sinks.SCAN_COLUMNS[6:])],
    )
    return sinks.scan_csv(rows)


@query(f"""WITH {HIST}, x AS (SELECT t.project_id AS project, 'main' AS branch, 'abc' AS head, 1 AS a, 2 AS b, 'Activity' AS mode, 'SourceOnly' AS scope,
  CASE WHEN commits = 0 THEN 'No commits' ELSE '' END AS status, commits, changed_files, binary_files, coalesce(path, '') AS path, f.added, f.deleted, f.modified, f.added - f.deleted AS net, f."binary",
  CASE WHEN path IS NULL THEN 'ProjectStatus' ELSE 'File' END AS kind FROM t LEFT JOIN f USING (project_id)
  UNION ALL SELECT 'All projects', 'main', 'abc', 1, 2, 'Activity', 'SourceOnly', CAST(count(*) AS VARCHAR) || ' projects; 0 incomplete/unavailable', sum(commits), sum(changed_files), sum(binary_files), '',
    sum(added), sum(deleted), sum(modified), sum(net), NULL, 'Totals' FROM t)
SELECT '"' || project || '","' || branch || '","' || head || '","1","2","Activity","SourceOnly","' || status || '","' || CAST(commits AS VARCHAR) || '","' || CAST(changed_files AS VARCHAR) || '","' || CAST(binary_files AS VARCHAR)
  || '","' || path || '","' || coalesce(CAST(added AS VARCHAR), '') || '","' || coalesce(CAST(deleted AS VARCHAR), '') || '","' || coalesce(CAST(modified AS VARCHAR), '') || '","' || coalesce(CAST(net AS VARCHAR), '')
  || '","' || coalesce(CASE "binary" WHEN true THEN 'True' WHEN false THEN 'False' END, '') || '","' || kind || '"' AS line FROM x""")
def history_export(spark, sf_dir):
    """The 18 columns of the history export."""
    files, projects = history_rows(spark, sf_dir)
    said = projects.withColumn("status", history.status(F.col("commits"), F.lit(False), F.lit(False), F.lit(True), "Activity"))
    rows = history.export_rows(said, files, history.grand_totals(projects))
    return sinks.history_csv(rows, "main", "abc", 1, 2, "Activity", "SourceOnly")


_CELL = "'\"' || coalesce({}, '') || '\"'"
_PLAIN = lambda c: _CELL.format(f"CAST({c} AS VARCHAR)")
_DOUBLE = lambda c: _CELL.format(f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')")


@query(f"""WITH tl AS ({timeline_sql()}), n AS (SELECT *, CASE WHEN physical IS NULL THEN 'Not scanned yet' WHEN carried = projects THEN 'Not scanned this day; latest earlier scan shown'
  WHEN carried > 0 THEN CAST(carried AS VARCHAR) || ' of ' || CAST(projects AS VARCHAR) || ' projects from earlier days' END AS n1, CASE WHEN scope_changed THEN 'Counting scope or tokenizer changed' END AS n2 FROM tl)
SELECT {" || ',' || ".join([_PLAIN(c) if c not in ("ai_tokens", "ai_cost") else _DOUBLE(c) for c in sinks.DAILY_COLUMNS[:-2]])} || ',' || {_CELL.format("CASE ai_partial WHEN true THEN 'True' WHEN false THEN 'False' END")}
  || ',' || {_CELL.format("concat_ws(' • ', n1, n2)")} AS line FROM n""")
def daily_export(spark, sf_dir):
    """The 17 columns of the daily log's export."""
    rows = dailylog.notes(dailylog.timeline(day_lines(spark, sf_dir), ai_days(spark, sf_dir)))
    return sinks.guarded_csv(rows, sinks.DAILY_COLUMNS)


@query(f"""WITH {AGENT}, {ACUBE_DAY} SELECT day AS date, input + cw + cr + output AS tokens, round(cost, 9) AS cost, cost_tokens < (input + cw + cr + output) * 0.999 AS cost_partial FROM aday""")
def daily_ai_record(spark, sf_dir):
    """What a usage load writes into the daily log: a row a day, into an empty log."""
    days = dailylog.ai_rows(priced_cube(spark, sf_dir))
    return rounded(dailylog.record_ai(days.limit(0), days, "2024-01-16"), "cost")


@query(f"""WITH {AGENT}, s AS (SELECT agent, CASE WHEN session = '' THEN 'unknown' ELSE session END AS sid, min(ts) AS start, max(ts) AS "end" FROM priced GROUP BY ALL)
SELECT count(*) AS sessions, min(start) AS first_start, (SELECT array_to_string(list_sort(list(DISTINCT agent || '::' || model)), ',') FROM priced) AS keys FROM s""")
def agent_payload_head(spark, sf_dir):
    """Sessions by start and keys in ordinal order, as the page of all agents holds them."""
    rows = report_rows(spark, sf_dir).where("tab = 'all'").withColumn("r", F.from_json("row", "array<string>"))
    key, session = F.when(F.col("section") == "keys", F.struct("place", F.col("r")[0].alias("k"))), F.col("section") == "sessions"
    return rows.agg(
        F.count_if(session).alias("sessions"), F.min_by(F.col("r")[2].cast("long"), F.when(session, F.col("place"))).alias("first_start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["k"]), ",").alias("keys"),
    )


def report_rows(spark, sf_dir: str) -> DataFrame:
    """The agents' report written as pages and read back."""
    priced = usage.with_agent_cost(usage.keep_first(agent_records(spark, sf_dir)))
    folder = os.path.join(files.shared_folder(spark, "reports"), uuid.uuid4().hex)
    pages.write(reports.agent_sections(usage.agent_cube(priced), usage.agent_sessions(priced)), folder, {})
    return pages.read(spark, folder)


@query(f"""WITH {AGENT}, told AS ({ORACLES["usage_agent_sessions"]}), cells AS (
  SELECT unnest(['all', agent]) AS tab, 'hours' AS section, day AS o1, hour AS o2, 0 AS o3, agent || '::' || model AS o4, day || '|' || CAST(hour AS VARCHAR) || '|' || agent || '::' || model AS label,
    input + cw + cr + output AS tokens, requests, cost FROM acube
  UNION ALL SELECT unnest(['all', agent]), 'sessions', '', start, first_pos, '', concat_ws('|', agent, id, CAST(start AS VARCHAR), CAST("end" AS VARCHAR), cwd, top_key), input + cw + cr + output, requests, cost FROM told
  UNION ALL SELECT DISTINCT unnest(['all', agent]), 'keys', agent || '::' || model, 0, 0, '', agent || '::' || model, NULL, NULL, NULL FROM acube)
SELECT tab, section, row_number() OVER (PARTITION BY tab, section ORDER BY o1, o2, o3, o4) - 1 AS place, label, tokens, requests, round(cost, 9) AS cost FROM cells""")
def report_page_rows(spark, sf_dir):
    """Every row of every page at its place: keys, hours and sessions of each agent and of all."""
    r, hours, sessions = F.col("r"), F.col("section") == "hours", F.col("section") == "sessions"
    rows = report_rows(spark, sf_dir).withColumn("r", F.from_json("row", "array<string>"))
    vector = F.when(hours, F.from_json(r[3], "array<double>")).when(sessions, F.slice(r, 7, 8).cast("array<double>"))
    names = F.when(hours, F.slice(r, 1, 3)).when(sessions, F.slice(r, 1, 6)).otherwise(r)
    v = F.col("v")
    return rows.withColumn("v", vector).select(
        "tab", "section", "place", F.array_join(names, "|").alias("label"), (v[0] + v[1] + v[2] + v[3]).alias("tokens"), v[4].alias("requests"), F.round(v[6], 9).alias("cost")
    )


@query("""SELECT 'P' || CAST(s_suppkey AS VARCHAR) AS name, 'C:\\\\w\\\\' || s_name AS root_path, s_suppkey AS ord FROM supplier WHERE s_suppkey % 9 <> 0""".replace("\\\\", "\\"))
def project_list(spark, sf_dir):
    """Project lists of a thousand projects each, written and read back; entries without a folder go."""
    k, block = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 1000).alias("block")
    root = F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("C:\\w\\"), "s_name"))
    projects = table(spark, sf_dir, "supplier").select(block, k.alias("ord"), F.concat(F.lit("P"), k.cast("string")).alias("name"), root.alias("root_path"))
    found = sinks.imported(sinks.project_documents(projects, "block"), "document")
    return found.select("name", "root_path", (F.col("block") * 1000 + F.col("ord")).cast("long").alias("ord"))


@query("""WITH a AS (SELECT 'c:\\w\\n' || CAST(s_nationkey AS VARCHAR) AS root_key, min(s_suppkey) AS ord FROM supplier GROUP BY 1) SELECT root_key, ord FROM a WHERE root_key NOT IN ('c:\\w\\n3', 'c:\\w\\n4')""")
def new_project_folders(spark, sf_dir):
    """Of projects with one folder, however it is spelled, the first is added if the folder is not configured."""
    s = table(spark, sf_dir, "supplier")
    spelled = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/mnt/c/W/./n"), F.col("s_nationkey").cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("C:\\w\\x\\..\\N"), F.col("s_nationkey").cast("string")))
    added = s.select(S.windows_path(spelled).alias("root_key"), F.col("s_suppkey").alias("ord"))
    old = spark.createDataFrame([("C:/w/n3",), ("/c/w/n4/",)], "p string").select(S.windows_path(F.col("p")).alias("root_key"))
    return metrics.new_projects(old, added)


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'NotFound' WHEN n_nationkey % 5 = 1 THEN 'Disabled' WHEN n_nationkey % 5 = 2 THEN 'Failed' WHEN n_nationkey % 5 = 3 THEN 'Empty' ELSE 'Loaded' END AS status FROM nation""")
def agent_status(spark, sf_dir):
    k = F.col("n_nationkey") % 5
    failed = F.when(k == 2, F.lit("IOError"))
    return table(spark, sf_dir, "nation").select("n_nationkey", usage.status_text(k != 0, k != 1, failed, F.when(k == 3, 0).otherwise(9)).alias("status"))


@query(f"WITH {SCAN}, c AS (SELECT * FROM lines WHERE project_id IN ('u0', 'u2')) SELECT date, count(*) AS projects, sum(files) AS files FROM c GROUP BY date")
def daily_chosen(spark, sf_dir):
    return dailylog.chosen(day_lines(spark, sf_dir), ["u0", "u2"]).groupBy("date").agg(F.count(F.lit(1)).alias("projects"), F.sum("files").alias("files"))


# ---- history ------------------------------------------------------------------------------------------------------------------

_OLD = "CASE WHEN l_linenumber % 5 = 0 THEN 'old/f' || CAST(l_partkey AS VARCHAR(20)) || '.cs' END"


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS hash, 'src/f' || CAST(l_partkey AS VARCHAR) || '.cs' AS path, {_OLD} AS old_path,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS added, CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_linenumber AS BIGINT) END AS deleted, l_returnflag = 'R' AS "binary" FROM lineitem""")
def numstat_files(spark, sf_dir):
    """``diff --numstat -z`` texts of all files of a commit, read back into rows."""
    i = table(spark, sf_dir, "lineitem")
    n = lambda c: F.when(F.col("l_returnflag") == "R", F.lit("-")).otherwise(F.col(c).cast("long").cast("string"))
    head = F.concat(n("l_quantity"), F.lit("\t"), n("l_linenumber"), F.lit("\t"))
    path = F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".cs"))
    old = F.concat(F.lit("old/f"), F.col("l_partkey").cast("string"), F.lit(".cs"))
    entry = F.when(F.col("l_linenumber") % 5 == 0, F.concat(head, F.lit("\x00"), old, F.lit("\x00"), path, F.lit("\x00"))).otherwise(F.concat(head, path, F.lit("\x00")))
    texts = joined(i.withColumn("ord", F.col("l_linenumber")), "l_orderkey", entry)
    return history.numstat_entries(texts.select(F.col("l_orderkey").cast("string").alias("hash"), F.array_join("items", "").alias("output")), keys=("hash",))


@query("""WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS hash, 'f' || CAST(l_linenumber AS VARCHAR) AS path, CAST(l_quantity AS BIGINT) AS n, l_linenumber AS k FROM lineitem)
SELECT hash, path, CASE WHEN k = 2 THEN 1000 ELSE n END AS added, 0::BIGINT AS deleted, false AS "binary" FROM e WHERE k IN (1, 2, 4) UNION ALL
SELECT hash, 'o3', 500, 0, false FROM e WHERE k = 3""")
def renames_across_scope(spark, sf_dir):
    """Line 2 was renamed into what counts, line 3 out of it, line 4 within it; 5 and on do not count."""
    e = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("hash"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path"),
        F.when(F.col("l_linenumber").isin(2, 3, 4), F.concat(F.lit("o"), F.col("l_linenumber").cast("string"))).alias("old_path"),
        F.col("l_quantity").cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"), F.lit(False).alias("binary"),
        F.col("l_linenumber").isin(1, 2, 4).alias("counts"), F.col("l_linenumber").isin(3, 4).alias("old_counts"),
    )
    plain = e.where("path in ('f2', 'f3')").select(
        "hash", F.when(F.col("path") == "f3", F.lit("o3")).otherwise(F.col("path")).alias("path"), F.when(F.col("path") == "f3", 500).otherwise(1000).cast("long").alias("added"), "deleted", "binary", F.lit(True).alias("counts")
    )
    return history.split_renames(e, plain, ["hash"])


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'No commits' WHEN o_custkey % 4 = 1 AND o_custkey % 3 = 0 THEN 'Incomplete: shallow boundary excluded' WHEN o_custkey % 4 = 1 THEN 'Incomplete: shallow local history' END AS activity,
  CASE WHEN o_custkey % 4 = 0 THEN 'No commits' WHEN o_custkey % 4 = 1 AND o_custkey % 3 <> 0 THEN 'Unavailable: period starts before available shallow history' WHEN o_custkey % 4 = 1 THEN 'Incomplete: shallow local history' END AS net FROM orders""")
def history_status(spark, sf_dir):
    k = F.col("o_custkey")
    said = lambda mode: history.status(k % 4, k % 4 == 1, k % 3 == 0, k % 3 == 0, mode)
    return table(spark, sf_dir, "orders").select("o_orderkey", said("Activity").alias("activity"), said("NetChange").alias("net"))


# ---- scalars ------------------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT o_orderkey, o_custkey % 1500 - 720 AS m FROM orders) SELECT o_orderkey, 'local (UTC' || CASE WHEN m < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', abs(m) // 60, abs(m) % 60) || ')' AS label FROM x""")
def zone_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.zone_label(F.col("o_custkey") % 1500 - 720).alias("label"))


@query(f"""WITH {REC} SELECT ord, CASE CAST(ord % 5 AS INT) WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 1 THEN ts - 7200000 ELSE ts END AS ms FROM rec""")
def iso_timestamps(spark, sf_dir):
    wall = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    text = F.element_at(F.array(F.concat(wall, F.lit("Z")), F.concat(wall, F.lit("+02:00")), wall, F.lit("soon"), F.lit("")), (F.col("ord") % 5 + 1).cast("int"))
    return records(spark, sf_dir).select("ord", S.parse_timestamp(text).alias("ms"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS a, floor(l_quantity) * 1e15 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, regexp_replace(CAST(a AS VARCHAR), '\\.0$', '') AS plain, CAST(CAST(b AS BIGINT) AS VARCHAR) AS whole FROM x""")
def js_number_texts(spark, sf_dir):
    a = F.col("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.js_number_text(a).alias("plain"), S.js_number_text(F.floor("l_quantity") * 1e15).alias("whole"))


@query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (l_linenumber - 3) / 2 + 0.5) AS half_up FROM lineitem""")
def js_rounded(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.js_round(F.col("l_extendedprice") * (F.col("l_linenumber") - 3) / 2).alias("half_up"))


@query("""SELECT o_orderkey, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 2 THEN o_custkey + 0.5 WHEN 3 THEN 0 WHEN 4 THEN -(o_custkey::DOUBLE) ELSE NULL END::DOUBLE AS n FROM orders""")
def js_numbers(spark, sf_dir):
    c = F.col("o_custkey").cast("string")
    forms = F.array(F.concat(F.lit(" "), c, F.lit("\n")), F.concat(F.lit("0x"), F.hex("o_custkey")), F.concat(c, F.lit(".5e0")), F.lit(" \t"), F.concat(F.lit("-"), c), F.concat(c, F.lit("px")))
    n = S.js_to_number(F.element_at(forms, (F.col("o_orderkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(~F.isnan(n), n).alias("n"))


@query("""WITH x AS (SELECT event_id, user_id, event_id % 4 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 't' || CAST(user_id AS VARCHAR) WHEN 2 THEN 'true' END AS shown,
  CASE k WHEN 0 THEN CASE WHEN user_id = 0 THEN 'b' ELSE CAST(user_id AS VARCHAR) END WHEN 1 THEN 't' || CAST(user_id AS VARCHAR) WHEN 2 THEN 'true' ELSE 'b' END AS either,
  CASE WHEN k = 0 THEN user_id ELSE 0 END AS whole, CASE WHEN k = 1 THEN 't' || CAST(user_id AS VARCHAR) ELSE '' END AS text FROM x""")
def json_values(spark, sf_dir):
    """One member that is a number, a text, true or null, read as each kind."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id").cast("string")
    value = F.element_at(F.array(u, F.concat(F.lit('"t'), u, F.lit('"')), F.lit("true"), F.lit("null")), (F.col("event_id") % 4 + 1).cast("int"))
    v = J.parse(F.concat(F.lit('{"a":'), value, F.lit(',"b":"b"}')))
    e = e.select("event_id", v.alias("v"))
    return e.select("event_id", J.shown(F.col("v"), "$.a").alias("shown"), J.first_text(F.col("v"), "$.a", "$.b").alias("either"), J.long(F.col("v"), "$.a").alias("whole"), J.text(F.col("v"), "$.a").alias("text"))


@query("""WITH x AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS c, c_custkey % 4 AS k FROM customer) SELECT c_custkey,
  CASE k WHEN 0 THEN 'd:\\a b\\' || c WHEN 1 THEN '/home/é/' || c WHEN 2 THEN 'http://x/%41' || c END AS path, CASE k WHEN 0 THEN 'd:/a b/' || c WHEN 1 THEN 'home/é/' || c WHEN 2 THEN '//x/A' || c END AS decoded FROM x""")
def uri_paths(spark, sf_dir):
    """``file:`` URIs with and without a drive, other URIs, and a broken escape (null)."""
    c = F.col("c_custkey").cast("string")
    uri = F.element_at(F.array(F.concat(F.lit("file:///d%3A/a%20b/"), c), F.concat(F.lit("file:///home/%C3%A9/"), c), F.concat(F.lit("http://x/%41"), c), F.concat(F.lit("file:///%zz"), c)), (F.col("c_custkey") % 4 + 1).cast("int"))
    start = F.when(F.col("c_custkey") % 4 == 2, 6).otherwise(9)
    return table(spark, sf_dir, "customer").select("c_custkey", S.uri_to_path(uri).alias("path"), S.decode_uri(F.substring(uri, start, F.lit(1000))).alias("decoded"))


@query("""WITH x AS (SELECT o_orderkey, o_custkey * 7 AS s FROM orders) SELECT o_orderkey, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' ELSE '' END || printf('%02d:%02d', s % 3600 // 60, s % 60) AS text FROM x""")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.duration_text(F.col("o_custkey") * 7).alias("text"))


@query("""SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'Source Code Only' WHEN 1 THEN 'All Text Files' WHEN 2 THEN 'Documentation / Text' ELSE 'Other' END AS name FROM documents""")
def enum_names(spark, sf_dir):
    value = F.element_at(F.array(*map(F.lit, ("SourceOnly", "AllText", "DocumentationText", "Other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", S.display_name(value, S.ENUM_NAMES).alias("name"))


_GLOBS = {"src*/**/f?1.md": "src[^/]*/(?:.*/)?f[^/]1\\.md", "**/en/*": "(?:.*/)?en/[^/]*", "src1?/*/f*5.*": "src1[^/]/[^/]*/f[^/]*5\\.[^/]*", "src2/**": "src2/.*"}


@query("""WITH p AS (SELECT doc_id, source || '/' || lang || '/f' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.cs' END AS path FROM documents) SELECT doc_id, """
       + ", ".join(f"regexp_full_match(path, '{r}') AS g{i}" for i, r in enumerate(_GLOBS.values())) + " FROM p")
def glob_matches(spark, sf_dir):
    path = F.concat("source", F.lit("/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".cs"))
    found = [F.regexp_like(path, F.lit(f"^{paths.glob_regex(g)}$")).alias(f"g{i}") for i, g in enumerate(_GLOBS)]
    return table(spark, sf_dir, "documents").select("doc_id", *found)


@query("""SELECT doc_id, CASE CAST(doc_id % 5 AS INT) WHEN 4 THEN NULL ELSE coalesce(text, '') END AS text FROM documents""")
def decoded_texts(spark, sf_dir):
    """Bytes with each mark, without one, and bytes that are no text (null)."""
    t = F.coalesce("text", F.lit(""))
    marked = lambda mark, body: F.concat(F.unhex(F.lit(mark)), body)
    forms = F.array(t.cast("binary"), marked("EFBBBF", t.cast("binary")), marked("FFFE", F.encode(t, "UTF-16LE")), marked("FEFF", F.encode(t, "UTF-16BE")), F.concat(t.cast("binary"), F.unhex(F.lit("C3"))))
    return table(spark, sf_dir, "documents").select("doc_id", lines.decode_text(F.element_at(forms, (F.col("doc_id") % 5 + 1).cast("int"))).alias("text"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT)::VARCHAR AS k FROM events""")
def top_level_member(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", sinks.top_level_text(e, "props", "k").alias("k"))

"""Queries over the driver's tables and the SQL that says what they must return.

``events`` stands in for usage records, ``documents`` and ``pages`` for files, ``orders`` and ``lineitem`` for commits and file
changes.  Derived columns are formulas that mean the same in Spark SQL and in the oracle's SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import lenient_json as J
from ..functions import scalars as S
from ..operators import dailylog, history, lines, metrics, paths, usage
from ..sources import sinks
from . import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stand-ins ------------------------------------------------------------------------------------------------------------

MODELS = ["claude-opus-5", "claude-sonnet-4-5", "claude-haiku-4-5", "gpt-5.5", "mystery-1"]
_KINDS = ["click", "view", "purchase", "error", "signup"]


def _record_columns(ms: str, k: str) -> str:
    """Formulas of both dialects."""
    return f"""event_id AS ord, {ms} AS ts,
      CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'claude-opus-5' WHEN 1 THEN 'claude-sonnet-4-5' WHEN 2 THEN 'claude-haiku-4-5'
        WHEN 3 THEN 'gpt-5.5' ELSE 'mystery-1' END AS model,
      CAST({k} AS BIGINT) AS input, event_id % 3 AS cw5m, event_id % 2 AS cw1h, (event_id % 5) * 10 AS cr,
      CAST(floor(abs(value)) AS BIGINT) % 20 AS output, event_id % 4 AS thinking,
      CASE WHEN user_id % 13 = 0 THEN '' ELSE 's' || CAST(user_id AS VARCHAR(20)) END AS session,
      CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(user_id AS VARCHAR(20)) || '-' || CAST(event_id % 7 AS VARCHAR(20)) END AS request,
      CASE WHEN event_id % 6 = 0 THEN '' ELSE '/d/work/p' || CAST(user_id % 4 AS VARCHAR(20)) || CASE WHEN event_id % 4 = 0 THEN '/sub/x' ELSE '' END END AS cwd,
      CASE WHEN event_id % 9 = 0 THEN '' ELSE 'b' || CAST(event_id % 3 AS VARCHAR(20)) END AS branch"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr(*_split_columns(_record_columns("unix_millis(CAST(ts AS TIMESTAMP))", "get_json_object(props, '$.k')").replace("VARCHAR(20)", "STRING")))


def _split_columns(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


REC = f"rec AS (SELECT {_record_columns('(epoch_us(ts) // 1000)', "json_extract_string(props, '$.k')")} FROM events)"
BEST = f"""{REC}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request ORDER BY output DESC, ord) AS rn, min(ord) OVER (PARTITION BY request) AS first_ord FROM rec
), best AS (
  SELECT * EXCLUDE (rn, first_ord, ord), CASE WHEN request = '' THEN ord ELSE first_ord END AS pos FROM ranked WHERE request = '' OR rn = 1
)"""
SUM6 = "sum(input) AS input, sum(cw5m) AS cw5m, sum(cw1h) AS cw1h, sum(cr) AS cr, sum(output) AS output, sum(thinking) AS thinking, count(*) AS requests"
CAST6 = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("input", "cw5m", "cw1h", "cr", "output", "thinking"))


def agent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select(
        F.concat(F.lit("agent"), (F.col("ord") % 3).cast("string")).alias("agent"), "ts", "model",
        *[F.col(c).cast("double").alias(c) for c in ("input",)], (F.col("cw5m") + F.col("cw1h")).cast("double").alias("cw"),
        *[F.col(c).cast("double").alias(c) for c in ("cr", "output", "thinking")],
        F.when(F.col("ord") % 10 == 0, F.lit(0.25)).alias("cost"), "session", "request", "cwd", (F.col("ord") % 2 + 1).cast("int").alias("calls"), "ord",
    )


# Prices as rows of the oracle: model, input, cache read, cache write, output.
_PRICES = ", ".join(
    f"('{m}', {i}, {r}, {w}, {o})"
    for m, i, r, w, o in [
        *[(m, i, i * dims.CACHE_READ if r is None else r, i * dims.WRITE_5M, o) for m, i, o, r in dims.CLAUDE_RATES],
        *[(m, i, i if r is None else r, i if w is None else w, o) for m, i, r, w, o in dims.AGENT_RATES],
    ]
)
AGENT = f"""{REC}, agent AS (
  SELECT 'agent' || CAST(ord % 3 AS VARCHAR) AS agent, ts, model, CAST(input AS DOUBLE) AS input, CAST(cw5m + cw1h AS DOUBLE) AS cw, CAST(cr AS DOUBLE) AS cr,
    CAST(output AS DOUBLE) AS output, CAST(thinking AS DOUBLE) AS thinking, CASE WHEN ord % 10 = 0 THEN 0.25::DOUBLE END AS cost, session, request, cwd,
    CAST(ord % 2 + 1 AS INT) AS calls, ord FROM rec
), firsts AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY agent, request ORDER BY ord) AS rn FROM agent) WHERE request = '' OR rn = 1
), price(pm, ri, rr, rw, ro) AS (VALUES {_PRICES}),
priced AS (
  SELECT f.* EXCLUDE (cost), coalesce(cost, (input * ri + cw * rw + cr * rr + output * ro) / 1e6) AS cost FROM firsts f LEFT JOIN price ON pm = model
), acube AS (
  SELECT strftime(epoch_ms(ts), '%Y-%m-%d') AS day, hour(epoch_ms(ts)) AS hour, agent, model, sum(input) AS input, sum(cw) AS cw, sum(cr) AS cr,
    sum(output) AS output, sum(thinking) AS thinking, CAST(sum(calls) AS DOUBLE) AS requests, coalesce(sum(cost), 0) AS cost,
    sum(CASE WHEN cost IS NOT NULL THEN input + cw + cr + output ELSE 0 END) AS cost_tokens
  FROM priced GROUP BY ALL
)"""
MEASURES = ", ".join(f"sum({c}) AS {c}" for c in usage.AGENT_MEASURES)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on their order; results are compared to nine places."""
    return df.withColumns({c: F.round(c, 9) for c in names})


def priced_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.agent_cube(usage.with_agent_cost(usage.keep_first(agent_records(spark, sf_dir))))


# ---- usage ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {BEST} SELECT * FROM best")
def usage_dedup_best(spark, sf_dir):
    return usage.best_copies(records(spark, sf_dir))


@query(f"""WITH {REC}, c AS (
  SELECT *, max(struct_pack(o := output, n := -ord, a := input, b := cw5m, c := cw1h, d := cr)) OVER (
    PARTITION BY request ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM rec WHERE request <> ''
), m AS (
  SELECT w IS NOT NULL AS dup, w IS NOT NULL AND NOT (w.a = input AND w.b = cw5m AND w.c = cw1h AND w.d = cr AND w.o = output) AS part FROM c
  UNION ALL SELECT false, false FROM rec WHERE request = ''
) SELECT count(*) AS raw, count(*) FILTER (NOT dup) AS counted, count(*) FILTER (dup) AS duplicates, count(*) FILTER (part) AS partials,
  count(*) / count(*) FILTER (NOT dup) AS inflation FROM m""")
def usage_dedup_stats(spark, sf_dir):
    return usage.dedup_stats(records(spark, sf_dir))


@query(f"WITH {REC} SELECT model, {SUM6} FROM rec GROUP BY model")
def usage_app_basis(spark, sf_dir):
    return usage.app_basis(records(spark, sf_dir))


@query(f"WITH {BEST} SELECT strftime(epoch_ms(ts), '%Y-%m-%d') AS day, hour(epoch_ms(ts)) AS hour, model, {SUM6} FROM best GROUP BY ALL")
def usage_hourly_cube(spark, sf_dir):
    return usage.hourly_cube(usage.best_copies(records(spark, sf_dir)))


@query(f"""WITH {BEST} SELECT strftime(epoch_ms(ts + 10800000), '%Y-%m-%d') AS day, hour(epoch_ms(ts + 10800000)) AS hour, model, {SUM6} FROM best GROUP BY ALL""")
def usage_tz_buckets(spark, sf_dir):
    return usage.hourly_cube(usage.best_copies(records(spark, sf_dir)), "+03:00")


_SESSIONS = f"""{BEST}, s AS (SELECT *, CASE WHEN session = '' THEN 'unknown' ELSE session END AS id FROM best), n AS (
  SELECT *, coalesce(ts > max(ts) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM s
), t AS (SELECT id, model, sum(output + cr) AS w, min(pos) AS p FROM s GROUP BY ALL),
top AS (SELECT id, model AS top_model FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, p) AS rn FROM t) WHERE rn = 1)"""


@query(f"""WITH {_SESSIONS} SELECT id, min(ts) AS start, max(ts) AS "end", count(*) AS requests, sum(input) AS input, sum(cw5m) AS cw5m, sum(cw1h) AS cw1h,
  sum(cr) AS cr, sum(output) AS output, coalesce(arg_max(cwd, pos) FILTER (new AND cwd <> ''), '') AS cwd,
  coalesce(arg_max(branch, pos) FILTER (new AND branch <> ''), '') AS branch, min(pos) AS first_pos, any_value(top_model) AS top_model
  FROM n JOIN top USING (id) GROUP BY id""")
def usage_sessions(spark, sf_dir):
    return usage.claude_sessions(usage.best_copies(records(spark, sf_dir)))


@query(f"WITH {_SESSIONS} SELECT * FROM top")
def usage_top_key(spark, sf_dir):
    return usage.claude_sessions(usage.best_copies(records(spark, sf_dir))).select("id", "top_model")


@query(f"""WITH {BEST} SELECT count(*) AS counted, min(ts) AS first_ts, max(ts) AS last_ts,
  count(DISTINCT CASE WHEN session = '' THEN 'unknown' ELSE session END) AS sessions, list_sort(list(DISTINCT model)) AS models,
  list_sort(list(DISTINCT model) FILTER (model IN ('gpt-5.5', 'mystery-1'))) AS unknown_models FROM best""")
def usage_summary(spark, sf_dir):
    return usage.summary(usage.best_copies(records(spark, sf_dir)))


@query(f"WITH {AGENT} SELECT *, (SELECT count(*) FROM agent) - (SELECT count(*) FROM firsts) AS dropped FROM firsts")
def usage_keep_first(spark, sf_dir):
    rows = agent_records(spark, sf_dir)
    kept = usage.keep_first(rows)
    counts = rows.agg(F.count(F.lit(1)).alias("n")).join(kept.agg(F.count(F.lit(1)).alias("m")))  # one row each
    return kept.join(F.broadcast(counts.select((F.col("n") - F.col("m")).alias("dropped"))))


@query(f"WITH {AGENT} SELECT * REPLACE (round(cost, 9) AS cost) FROM acube")
def usage_agent_cube(spark, sf_dir):
    return rounded(priced_cube(spark, sf_dir), "cost")


@query(f"""WITH {AGENT}, s AS (SELECT * EXCLUDE (ord), ord AS pos, CASE WHEN session = '' THEN 'unknown' ELSE session END AS sid FROM priced), n AS (
  SELECT *, coalesce(ts >= max(ts) OVER (PARTITION BY agent, sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM s
), t AS (SELECT agent, sid, model, sum(output + cr + input) AS w, min(pos) AS p FROM s GROUP BY ALL),
top AS (SELECT agent, sid, agent || '::' || model AS top_key FROM (SELECT *, row_number() OVER (PARTITION BY agent, sid ORDER BY w DESC, p) AS rn FROM t) WHERE rn = 1)
SELECT agent, arg_min(session, pos) AS id, min(ts) AS start, max(ts) AS "end", coalesce(arg_max(cwd, pos) FILTER (new AND cwd <> ''), '') AS cwd,
  sum(input) AS input, sum(cw) AS cw, sum(cr) AS cr, sum(output) AS output, sum(thinking) AS thinking, CAST(sum(calls) AS DOUBLE) AS requests,
  round(coalesce(sum(cost), 0), 9) AS cost, sum(CASE WHEN cost IS NOT NULL THEN input + cw + cr + output ELSE 0 END) AS cost_tokens,
  min(pos) AS first_pos, any_value(top_key) AS top_key FROM n JOIN top USING (agent, sid) GROUP BY agent, sid""")
def usage_agent_sessions(spark, sf_dir):
    return rounded(usage.agent_sessions(usage.with_agent_cost(usage.keep_first(agent_records(spark, sf_dir)))), "cost")


@query(f"""WITH {AGENT} SELECT agent, {MEASURES.replace("sum(cost) AS cost,", "round(sum(cost), 9) AS cost,")} FROM acube GROUP BY ROLLUP (agent)""")
def usage_totals_by_agent(spark, sf_dir):
    return rounded(usage.rolled_up(priced_cube(spark, sf_dir)), "cost")


@query(f"""WITH {AGENT} SELECT day, cost_tokens < (input + cw + cr + output) * 0.999 AS cost_partial FROM
  (SELECT day, {MEASURES} FROM acube GROUP BY day)""")
def usage_partial_flag(spark, sf_dir):
    days = usage.totals(priced_cube(spark, sf_dir), "day")
    return days.select("day", usage.partial_flag().alias("cost_partial"))


@query(f"""WITH {AGENT} SELECT model, {MEASURES.replace("sum(cost) AS cost,", "round(sum(cost), 9) AS cost,")} FROM acube
  WHERE day > '2024-01-20' AND agent <> 'agent1' GROUP BY model""")
def usage_filtered_totals(spark, sf_dir):
    cube = priced_cube(spark, sf_dir).where((F.col("day") > "2024-01-20") & (F.col("agent") != "agent1"))
    return rounded(usage.totals(cube, "model"), "cost")


_CLAUDE_PRICES = ", ".join(
    f"('{m}', {i}, {o}, {i * dims.CACHE_READ if r is None else r}, {i * dims.WRITE_5M}, {i * dims.WRITE_1H})" for m, i, o, r in dims.CLAUDE_RATES
)


@query(f"""WITH {REC}, price(pm, ri, ro, rr, r5, r1) AS (VALUES {_CLAUDE_PRICES})
SELECT ord, round((input * coalesce(ri, 5) + cw5m * coalesce(r5, 6.25) + cw1h * coalesce(r1, 10) + cr * coalesce(rr, 0.5) + output * coalesce(ro, 25)) / 1e6, 9) AS cost,
  pm IS NOT NULL AS known FROM rec LEFT JOIN price ON pm = model""")
def usage_cost_fallback(spark, sf_dir):
    return usage.with_claude_cost(records(spark, sf_dir)).select("ord", F.round("cost", 9).alias("cost"), "known")


@query(f"""WITH {BEST}, price(pm, ri, ro, rr, r5, r1) AS (VALUES {_CLAUDE_PRICES})
SELECT model, count(*) AS n, sum(input) AS input, sum(cw5m + cw1h) AS cw, round(sum((input * coalesce(ri, 5) + cw5m * coalesce(r5, 6.25) + cw1h * coalesce(r1, 10)
  + cr * coalesce(rr, 0.5) + output * coalesce(ro, 25)) / 1e6), 9) AS cost FROM best LEFT JOIN price ON pm = model GROUP BY model""")
def usage_from_claude(spark, sf_dir):
    rows = usage.from_claude(records(spark, sf_dir)).groupBy("model")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("input").alias("input"), F.sum("cw").alias("cw"), F.round(F.sum("cost"), 9).alias("cost"))


@query(f"""WITH {REC} SELECT ord, ts FROM rec WHERE ts >= (SELECT epoch_ms(date_trunc('day', epoch_ms(max(ts) + 10800000)) - INTERVAL 6 DAY) - 10800000 FROM rec)""")
def usage_last_n_days(spark, sf_dir):
    return usage.last_days(records(spark, sf_dir), 7, "+03:00").select("ord", "ts")


@query(f"""WITH {REC} SELECT ord FROM rec WHERE ts BETWEEN 1704844800000 AND 1705017600000""")
def usage_window(spark, sf_dir):
    return usage.in_window(records(spark, sf_dir), 1704844800000, 1705017600000).select("ord")


_ROOTS = [("p0", "D:\\work\\p0"), ("p0sub", "d:/work/p0/sub"), ("p1", "/mnt/d/work/p1/"), ("p2", "D:/work/./x/../p2"), ("none", "d:\\wor"), ("twin", "D:/WORK/P1")]


@query(f"""WITH {AGENT}, s AS (SELECT *, ord AS pos, CASE WHEN session = '' THEN 'unknown' ELSE session END AS sid FROM priced), n AS (
  SELECT *, coalesce(ts >= max(ts) OVER (PARTITION BY agent, sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM s
), x AS (SELECT agent, sid, arg_max(cwd, pos) FILTER (new AND cwd <> '') AS cwd, sum(input + cw + cr + output) AS tokens, sum(cost) AS cost,
  sum(CASE WHEN cost IS NOT NULL THEN input + cw + cr + output ELSE 0 END) AS ct FROM n GROUP BY agent, sid),
root(project_id, r) AS (VALUES ('p0', '/d/work/p0'), ('p0sub', '/d/work/p0/sub'), ('p1', '/d/work/p1'), ('p2', '/d/work/p2'), ('none', '/d/wor'), ('twin', NULL)),
hit AS (SELECT x.*, arg_max(project_id, length(r)) AS project_id FROM x JOIN root ON x.cwd = r OR starts_with(x.cwd, r || '/') GROUP BY ALL)
SELECT root.project_id, count(agent) AS sessions, coalesce(sum(tokens), 0) AS tokens, round(coalesce(sum(cost), 0), 9) AS cost,
  coalesce(sum(ct) < sum(tokens) * 0.999, false) AS cost_partial FROM root LEFT JOIN hit USING (project_id) GROUP BY root.project_id""")
def session_attribution(spark, sf_dir):
    sessions = usage.agent_sessions(usage.with_agent_cost(usage.keep_first(agent_records(spark, sf_dir))))
    roots = spark.createDataFrame([(p, r, i) for i, (p, r) in enumerate(_ROOTS)], "project_id string, root_path string, ord int")
    return rounded(usage.match_projects(sessions, roots), "cost")


@query(f"""WITH {REC} SELECT ord FROM (SELECT ord, input, lag(input, 1, -1) OVER (PARTITION BY session ORDER BY ord) AS prev FROM rec) WHERE input <> prev""")
def reemit_suppression(spark, sf_dir):
    from pyspark.sql.window import Window

    prev = F.lag("input", 1, -1).over(Window.partitionBy("session").orderBy("ord"))
    return records(spark, sf_dir).withColumn("prev", prev).where("input <> prev").select("ord")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS state,
  first_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS opened FROM conversations""")
def state_propagation(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = lambda role: F.when(F.col("role") == role, F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.last(said("system"), ignorenulls=True).over(w).alias("state"), F.first(said("user"), ignorenulls=True).over(w).alias("opened")
    )


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, 0.0::DOUBLE AS as_text, true AS k_true FROM events
  WHERE contains(props, '"k"') AND length(props) >= 8 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) <> 0
  UNION ALL SELECT event_id, 0.0, 0.0, false FROM events WHERE contains(props, '"k"') AND length(props) >= 8 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) = 0""")
def token_prefilter_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.contains("props", F.lit('"k"')) & (F.length("props") >= 8))
    e = e.withColumn("v", J.parse(F.col("props"))).withColumn("t", J.parse(F.concat(F.lit('{"k":"'), F.get_json_object("props", "$.k"), F.lit('"}'))))
    return e.select("event_id", J.num(F.col("v"), "$.k").alias("k"), J.num(F.col("t"), "$.k").alias("as_text"), J.truthy(F.col("v"), "$.k").alias("k_true"))


_IDS = ["claude-haiku-4-5-20251001", "anthropic.claude-opus-5", "claude-sonnet-4-5@20250929", "omni/kr/claude-sonnet-4.5-high", "z-ai/glm-5.3-flash", "gemini-3-flash", "x:free", "MODEL-FREE", "claude-opus-4-8"]
_ID_LIST = ", ".join(f"'{m}'" for m in _IDS)


@query(f"""WITH i AS (SELECT event_id, [{_ID_LIST}][event_id % {len(_IDS)} + 1] || CASE WHEN event_id % 4 = 0 THEN '-' || CAST(user_id AS VARCHAR) ELSE '' END AS m FROM events), n AS (
  SELECT event_id, m, regexp_replace(regexp_replace(regexp_replace(m, '-[0-9]{{8}}$', ''), '^anthropic\\.', ''), '@[0-9]{{8}}$', '') AS plain,
    regexp_replace(list_extract(string_split(lower(m), '/'), -1), '-(thinking|xhigh|high|medium|low|max|agent)$', '') AS a FROM i
) SELECT event_id, m, plain, CASE WHEN a = 'gemini-3-flash' THEN 'gemini-3-flash-preview' ELSE a END AS agent_id,
  regexp_matches(m, '(?i)(:free|-free)$') AS free,
  CASE WHEN regexp_matches(plain, '^claude-(opus|sonnet|haiku|fable|mythos)-[0-9]+(-[0-9]+)?$') THEN
    upper(substr(split_part(plain, '-', 2), 1, 1)) || substr(split_part(plain, '-', 2), 2) || ' ' || split_part(plain, '-', 3) ||
    CASE WHEN split_part(plain, '-', 4) <> '' THEN '.' || split_part(plain, '-', 4) ELSE '' END ELSE plain END AS shown FROM n""")
def model_names(spark, sf_dir):
    """An event's model: one of a few forms, on every fourth event with the user's number at its end."""
    m = F.col("m")
    form = F.get(F.array(*map(F.lit, _IDS)), (F.col("event_id") % len(_IDS)).cast("int"))
    tail = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("-"), F.col("user_id").cast("string"))).otherwise("")
    ids = table(spark, sf_dir, "events").select("event_id", F.concat(form, tail).alias("m"))
    return ids.select("event_id", "m", S.normalize_model(m).alias("plain"), S.agent_model(m).alias("agent_id"), S.is_free(m).alias("free"), S.display_model(m).alias("shown"))


# ---- source metrics -----------------------------------------------------------------------------------------------------------

_DOC = """l AS (SELECT doc_id, source, lang, regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n') AS a FROM documents),
d AS (SELECT doc_id, source, lang, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM l),
m AS (SELECT doc_id, source, lang, len(a) AS physical, len(list_filter(a, lambda x: regexp_matches(x, '^[\\s\\x0B\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{3000}]*$'))) AS blank FROM d)"""


def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", lines.text_metrics(F.col("text")).alias("m"))
    return docs.select("doc_id", "source", "lang", "m.*")


@query(f"WITH {_DOC} SELECT doc_id, physical, blank, physical - blank AS content FROM m")
def doc_line_metrics(spark, sf_dir):
    return doc_metrics(spark, sf_dir).select("doc_id", "physical", "blank", "content")


@query(f"""WITH {_DOC} SELECT source, lang, count(*) AS files, sum(physical) AS physical, sum(blank) AS blank, sum(physical - blank) AS content
  FROM m GROUP BY ROLLUP (source, lang)""")
def doc_metrics_rollup(spark, sf_dir):
    sums = [F.sum(c).alias(c) for c in ("physical", "blank", "content")]
    return doc_metrics(spark, sf_dir).rollup("source", "lang").agg(F.count(F.lit(1)).alias("files"), *sums)


@query(f"""WITH {_DOC}, g AS (SELECT source, lang, sum(physical) AS physical FROM m GROUP BY ALL)
SELECT source, lang, round(physical / sum(physical) OVER (PARTITION BY source), 9) AS share FROM g""")
def language_share(spark, sf_dir):
    g = doc_metrics(spark, sf_dir).groupBy("source", "lang").agg(F.sum("physical").alias("physical"))
    return metrics.shares(g, "source").select("source", "lang", F.round("share", 9).alias("share"))


@query(f"""WITH {_DOC}, f AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'Markdown' ELSE 'Text' END AS language FROM m)
SELECT source, language, 'DocumentationText' AS category, count(*) AS files, sum(physical) AS physical, sum(blank) AS blank, sum(physical - blank) AS lines FROM f GROUP BY ALL""")
def language_metrics(spark, sf_dir):
    docs = doc_metrics(spark, sf_dir).withColumns({"language": F.when(F.col("doc_id") % 3 == 0, "Markdown").otherwise("Text"), "category": F.lit(dims.TEXT)})
    out = metrics.by_language(docs.withColumns({"bytes": F.lit(0), "tokens": F.lit(0)}), "source")
    return out.select("source", "language", "category", "files", "physical", "blank", "lines")


@query(f"WITH {_DOC} SELECT 'DocumentationText' AS category, count(*) AS files, 0 AS tokens, sum(physical) AS physical, sum(physical - blank) AS lines FROM m")
def category_metrics(spark, sf_dir):
    return metrics.by_category(doc_metrics(spark, sf_dir).withColumns({"category": F.lit(dims.TEXT), "tokens": F.lit(0)}))


def _token_sql(rel: str, line: list[str], block: list[tuple[str, str]]) -> str:
    """The same token stream in the oracle's dialect: lists of pieces by line, as in the Spark plan."""
    pattern = lines.token_pattern(line, block, possessive=False).replace("'", "''")
    marks = " OR ".join([f"starts_with(t, '{m.replace(chr(39), chr(39) * 2)}')" for m in line]) or "false"
    opens = " OR ".join([f"starts_with(t, '{b}')" for b, _ in block]) or "false"
    brk = "regexp_split_to_array(t, '\\r\\n|\\r|\\n')"
    return f"""tok AS (SELECT id, regexp_extract_all(text, '{pattern}', 1) AS ts FROM {rel}),
codes AS (SELECT id, array_to_string(list_transform(ts, lambda t: CASE
    WHEN t IN (chr(13) || chr(10), chr(13), chr(10)) THEN '0'
    WHEN t[1] IN (chr(39), '"', '`') THEN '1'
    WHEN {marks} THEN '2'
    WHEN {opens} THEN array_to_string(list_transform({brk}, lambda p: CASE WHEN p = '' THEN '' ELSE '2' END), '0')
    WHEN regexp_matches(t, '^{lines.WS_INLINE}*$') THEN '3' ELSE '1' END), '') AS c FROM tok),
ls AS (SELECT id, string_split(c, '0') AS a FROM codes), l2 AS (SELECT id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM ls),
lm AS (SELECT id, len(a) AS physical, len(list_filter(a, lambda x: contains(x, '1'))) AS code, len(list_filter(a, lambda x: contains(x, '1') AND contains(x, '2'))) AS mixed,
  len(list_filter(a, lambda x: NOT contains(x, '1') AND contains(x, '2'))) AS comment FROM l2)
SELECT id, physical, physical - code - comment AS blank, code, comment, mixed FROM lm"""


_CODE = """coalesce(text, '') || chr(10) || '  // note' || chr(10) || 'x = "a // b \\" c"; /* in' || chr(10) || chr(10) || ' two */ y' || chr(13) || chr(10) || '/* open ' || coalesce(text, '')"""


@query(f"WITH src AS (SELECT doc_id AS id, {_CODE} AS text FROM documents), {_token_sql('src', *dims.C_LIKE)}")
def code_line_metrics(spark, sf_dir):
    text = F.expr(_CODE.replace('\\" c', '\\\\" c'))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))
    docs = docs.withColumns({"language": F.lit("C#"), "category": F.lit(dims.SOURCE)})
    return lines.line_metrics(docs).select("id", "physical", "blank", "code", "comment", "mixed")


@query(f"WITH src AS (SELECT page_id AS id, html AS text FROM pages), {_token_sql('src', *dims.XML_LIKE)}")
def html_line_metrics(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    pages = pages.withColumns({"language": F.lit("HTML"), "category": F.lit(dims.SOURCE)})
    return lines.line_metrics(pages).select("id", "physical", "blank", "code", "comment", "mixed")


_EXTS = [".cs", ".PY", ".json", ".md", "", ".unknown", ".cshtml", ".h", ".d.ts", ".gitignore"]
_PATH = "source || '/' || lang || '/f' || CAST(doc_id AS VARCHAR(20)) || CASE CAST(doc_id % 10 AS INT) " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTS)) + " END"
_CLASSES = {".cs": ("C#", dims.SOURCE), ".PY": ("Python", dims.SOURCE), ".json": ("JSON", dims.CONFIG), ".md": ("Markdown", dims.TEXT), ".cshtml": ("Razor", dims.SOURCE), ".h": ("C/C++", dims.SOURCE), ".d.ts": ("TypeScript", dims.SOURCE)}


@query(f"""WITH p AS (SELECT doc_id, {_PATH} AS path, CAST(doc_id % 10 AS INT) AS k FROM documents),
c(k, language, category) AS (VALUES {", ".join(f"({_EXTS.index(e)}, '{n}', '{c}')" for e, (n, c) in _CLASSES.items())})
SELECT doc_id, coalesce(language, 'Plain Text') AS language, coalesce(category, 'DocumentationText') AS category,
  CASE k WHEN 4 THEN '[no extension]' WHEN 8 THEN '.ts' ELSE regexp_extract(path, '\\.[a-zA-Z]+$') END AS extension,
  coalesce(category IN ('SourceCode', 'Configuration'), false) AS in_scope FROM p LEFT JOIN c USING (k)""")
def classify_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH.replace("VARCHAR(20)", "STRING")).alias("path"))
    some = paths.classify(docs, "SourceAndConfiguration").select("doc_id", F.lit(True).alias("in_scope"))
    every = paths.classify(docs, "AllText").withColumn("extension", S.extension_text(F.col("path")))
    return every.join(some, "doc_id", "left").select("doc_id", "language", "category", "extension", F.coalesce("in_scope", F.lit(False)).alias("in_scope"))


@query(f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents), r(ord, re, neg) AS (VALUES
  (0, '(?i)^(?:.*/)?fr(?:/.*)?$', false), (1, '(?i)^(?:.*/)?[^/]*\\.md$', false), (2, '(?i)^src1[^/]*/.*/[^/]*\\.md$', true), (3, '(?i)^src[^/]/en/f[^/]*\\.json$', false))
SELECT doc_id, coalesce(arg_max(NOT neg, ord), false) AS ignored FROM p LEFT JOIN r ON regexp_matches(path, re) GROUP BY doc_id""")
def ignore_last_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("p").alias("project_id"), F.expr(_PATH.replace("VARCHAR(20)", "STRING")).alias("path"), F.lit(False).alias("is_dir"))
    rules = paths.rules_frame(spark, ["# rules", "fr/", "*.md", "!src1*/**/*.md", "/src?/en/f*.json"])
    return paths.ignored(docs, rules, ["doc_id"])


# Whole texts, with control bytes put in before (1) or behind (3) the end of the window of long texts.
_SNIFFED = """substr(coalesce(text, ''), 1, CASE doc_id % 4 WHEN 1 THEN 4000 ELSE 9000 END) || repeat(chr(1) || chr(2), CASE WHEN doc_id % 4 IN (1, 3) THEN CAST(doc_id % 300 AS INT) ELSE 0 END)
  || substr(coalesce(text, ''), CASE doc_id % 4 WHEN 1 THEN 4001 ELSE 9001 END)"""


@query(f"""WITH h AS (SELECT doc_id, {_SNIFFED} AS t, doc_id % 7 = 0 AS z FROM documents),
b AS (SELECT doc_id, z, octet_length(encode(t)) AS size, hex(encode(t))[1:16384] AS x FROM h),
n AS (SELECT doc_id, z AND size < 8192 AS z, length(x) // 2 AS n, len(list_filter(regexp_extract_all(x, '..'), lambda p: regexp_matches(p, '^(0[0-7BCEF]|1[0-9A-F])$'))) AS c FROM b)
SELECT doc_id, z OR c > n // 20 AS binary FROM n""")
def binary_sniff(spark, sf_dir):
    # The zero at the end is seen if it stands among the first 8192 bytes.
    body = F.concat(F.expr(_SNIFFED).cast("binary"), F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", lines.looks_binary(body).alias("binary"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'changed' WHEN doc_id % 5 = 0 THEN 'new' ELSE 'reusable' END AS state FROM documents""")
def incremental_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    now = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("length"), F.lit(1).alias("modified"), "doc_id")
    old = now.where("doc_id % 5 <> 0 or doc_id % 4 = 0").select("path", (F.col("length") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("length"), "modified", F.lit("1").alias("version"))
    changed, same = metrics.manifest_diff(old, now, "1")
    changed = changed.join(old.select("path", F.lit(True).alias("was")), "path", "left")
    return changed.select("doc_id", F.when(F.col("was"), "changed").otherwise("new").alias("state")).unionByName(same.select("doc_id", F.lit("reusable").alias("state")))


@query("""WITH a AS (SELECT source AS project_id, count(*) AS files FROM documents GROUP BY source), b AS (SELECT project_id, files + 1000 AS files FROM a WHERE project_id < 'src13')
SELECT project_id, coalesce(b.files, a.files) AS files FROM a LEFT JOIN b USING (project_id) WHERE project_id <> 'src9'""")
def snapshot_merge(spark, sf_dir):
    old = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project_id")).agg(F.count(F.lit(1)).alias("files"))
    old = old.withColumns({"scope": F.lit("AllText"), "tokenizer": F.lit("t")})
    fresh = old.where("project_id < 'src13'").withColumn("files", F.col("files") + 1000)
    order = old.where("project_id <> 'src9'").select("project_id", F.xxhash64("project_id").alias("ord"))
    return metrics.merge_snapshot(old, fresh, order).select("project_id", "files")


# ---- daily log ----------------------------------------------------------------------------------------------------------------

# Every event is a scan and an assistant row; days without a scan of u1 come from a derived column: on every fifth day of a month its
# events are u0's.
_USER = "(CASE WHEN user_id % 6 = 1 AND day(ts) % 5 = 0 THEN 0 ELSE user_id % 6 END)"
_SCANS = f"""SELECT {{day}} AS date, 'u' || CAST({_USER} AS VARCHAR(20)) AS project_id, 'n' || CAST({_USER} AS VARCHAR(20)) AS name, event_id AS scanned_at,
  CASE WHEN event_id > 400 AND {_USER} = 2 THEN 'AllText' ELSE 'SourceOnly' END AS scope, 'O200k' AS tokenizer,
  event_id % 50 AS files, event_id AS bytes, event_id % 1000 AS tokens, event_id % 313 AS physical, event_id % 7 AS blank, event_id % 211 AS code, event_id % 13 AS comment, 0 AS content
  FROM events"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _split_columns(_SCANS.format(day="date_format(ts, 'yyyy-MM-dd')").replace("VARCHAR(20)", "STRING").removeprefix("SELECT").rsplit("FROM", 1)[0])
    return table(spark, sf_dir, "events").selectExpr(*columns)


def ai_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return e.agg(F.sum(F.col("event_id") % 10).cast("double").alias("tokens"), F.count(F.lit(1)).cast("double").alias("cost"), (F.count(F.lit(1)) % 2 == 0).alias("cost_partial"))


SCAN = f"""raw AS ({_SCANS.format(day="strftime(ts, '%Y-%m-%d')")}), lines AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY date, project_id ORDER BY scanned_at DESC) AS rn FROM raw) WHERE rn = 1),
ai AS (SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(sum(event_id % 10) AS DOUBLE) AS tokens, CAST(count(*) AS DOUBLE) AS cost, count(*) % 2 = 0 AS cost_partial FROM events GROUP BY 1)"""


def day_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scans(spark, sf_dir)
    return dailylog.record_lines(s.limit(0), s)


@query(f"WITH {SCAN} SELECT * FROM lines")
def daily_upsert(spark, sf_dir):
    return day_lines(spark, sf_dir)


_EFFECTIVE = "SELECT * EXCLUDE (rn), date <> '{d}' AS is_carried FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY date DESC) AS rn FROM lines WHERE date <= '{d}') WHERE rn = 1"


@query(f"WITH {SCAN} {_EFFECTIVE.format(d='2024-01-10')}")
def daily_effective(spark, sf_dir):
    return dailylog.effective(day_lines(spark, sf_dir), "2024-01-10")


_T = ", ".join(f"sum(l.{c}) AS {c}" for c in dailylog.TOTALS)
_LAST = "last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {SCAN}, days AS (SELECT date FROM lines UNION SELECT date FROM ai),
grid AS (SELECT d.date, l.* EXCLUDE (date), l.date AS on_date, row_number() OVER (PARTITION BY d.date, l.project_id ORDER BY l.date DESC) AS rn FROM days d JOIN lines l ON l.date <= d.date),
agg AS (SELECT l.date, count(*) AS projects, count(*) FILTER (on_date <> l.date) AS carried, {_T}, array_to_string(list_sort(list(DISTINCT scope || '/' || lower(tokenizer))), '+') AS contract
  FROM grid l WHERE rn = 1 GROUP BY l.date),
shown AS (SELECT date, coalesce(projects, 0) AS projects, coalesce(carried, 0) AS carried, {", ".join(f"a.{c}" for c in dailylog.TOTALS)}, contract, ai.tokens AS ai_tokens, ai.cost AS ai_cost, ai.cost_partial AS ai_partial
  FROM days LEFT JOIN agg a USING (date) LEFT JOIN ai USING (date) WHERE coalesce(projects, 0) > coalesce(carried, 0) OR coalesce(ai.tokens, 0) > 0)
SELECT date, projects, carried, {", ".join(dailylog.TOTALS)}, {", ".join(f"{c} - {_LAST.format(c=c)} AS delta_{c}" for c in ("physical", "code", "tokens"))}, ai_tokens, ai_cost, ai_partial,
  coalesce(contains(contract, '+') OR ({_LAST.format(c='contract')} IS NOT NULL AND contract <> {_LAST.format(c='contract')}), false) AS scope_changed FROM shown""")
def daily_timeline(spark, sf_dir):
    return dailylog.timeline(day_lines(spark, sf_dir), ai_days(spark, sf_dir))


def _pair_sql(body: str) -> str:
    return f"WITH {SCAN}, a AS ({_EFFECTIVE.format(d='2024-01-05')}), b AS ({_EFFECTIVE.format(d='2024-01-12')}) {body}"


_SIDE = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in dailylog.TOTALS)


@query(_pair_sql(f""", ta AS (SELECT {_SIDE}, (SELECT tokens FROM ai WHERE date = '2024-01-05') AS ai_tokens, (SELECT cost FROM ai WHERE date = '2024-01-05') AS ai_cost FROM a),
tb AS (SELECT {_SIDE}, (SELECT tokens FROM ai WHERE date = '2024-01-12') AS ai_tokens, (SELECT cost FROM ai WHERE date = '2024-01-12') AS ai_cost FROM b),
r AS ({" UNION ALL ".join(f"SELECT {i} AS ord, '{n}' AS metric, ta.{c} AS a, tb.{c} AS b, {str(m).lower()} AS is_currency FROM ta, tb" for i, (n, c, m) in enumerate(dailylog.COMPARED))})
SELECT *, b - a AS delta, CASE WHEN a <> 0 THEN (b - a) / a END AS delta_percent FROM r"""))
def daily_compare_metrics(spark, sf_dir):
    return dailylog.compare_metrics(day_lines(spark, sf_dir), ai_days(spark, sf_dir), "2024-01-05", "2024-01-12")


@query(f"""WITH {_DOC}, g AS (SELECT lang AS language, CASE WHEN lang = 'de' THEN 1 ELSE doc_id % 2 END AS side, sum(physical) AS physical, sum(physical - blank) AS code FROM m GROUP BY ALL),
a AS (SELECT * FROM g WHERE side = 0), b AS (SELECT * FROM g WHERE side = 1)
SELECT coalesce(a.language, b.language) AS language, 'DocumentationText' AS category, coalesce(a.physical, 0) AS lines_a, coalesce(a.code, 0) AS code_a, coalesce(b.physical, 0) AS lines_b,
  coalesce(b.code, 0) AS code_b, coalesce(b.physical, 0) - coalesce(a.physical, 0) AS delta_lines, coalesce(b.code, 0) - coalesce(a.code, 0) AS delta_code FROM a FULL JOIN b ON a.language = b.language""")
def daily_compare_languages(spark, sf_dir):
    """Every document; the language of one side is on that side by a derived column."""
    docs = doc_metrics(spark, sf_dir).withColumn("side", F.when(F.col("lang") == "de", 1).otherwise(F.col("doc_id") % 2))
    docs = docs.select("doc_id", F.col("lang").alias("language"), F.lit(dims.TEXT).alias("category"), "physical", F.col("content").alias("code"), "side")
    return dailylog.compare_languages(docs.where("side = 0").drop("side"), docs.where("side = 1").drop("side"))


@query(_pair_sql("""SELECT (SELECT array_to_string(list_sort(list(DISTINCT scope || '/' || lower(tokenizer))), '+') FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) AS contracts,
(SELECT count(DISTINCT scope) > 1 FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) AS differ, (SELECT bool_or(is_carried) FROM a) AS carried_a, (SELECT bool_or(is_carried) FROM b) AS carried_b"""))
def daily_contract(spark, sf_dir):
    day = day_lines(spark, sf_dir)
    return dailylog.warnings(dailylog.effective(day, "2024-01-05"), dailylog.effective(day, "2024-01-12"))


@query(f"""WITH {SCAN}, o AS (SELECT date, tokens + CAST(right(date, 1) AS INT) - 4 AS tokens, cost, cost_partial FROM ai WHERE date < '2024-01-25'), n AS (SELECT * FROM ai WHERE date > '2024-01-03')
SELECT coalesce(o.date, n.date) AS date, CASE WHEN t THEN n.tokens ELSE o.tokens END AS tokens, CASE WHEN t THEN n.cost ELSE o.cost END AS cost, CASE WHEN t THEN n.cost_partial ELSE o.cost_partial END AS cost_partial
FROM (SELECT o, n, n.date IS NOT NULL AND (o.date IS NULL OR o.date = '2024-01-16' OR n.tokens >= o.tokens) AS t FROM o FULL JOIN n ON o.date = n.date)""")
def daily_ai_merge(spark, sf_dir):
    ai = ai_days(spark, sf_dir)
    old = ai.where("date < '2024-01-25'").withColumn("tokens", F.col("tokens") + F.right("date", F.lit(1)).cast("int") - 4)
    return dailylog.record_ai(old, ai.where("date > '2024-01-03'"), "2024-01-16")


@query(f"WITH {SCAN} SELECT DISTINCT date FROM (SELECT date FROM lines UNION ALL SELECT date FROM ai) ORDER BY date DESC LIMIT 2")
def daily_default_pair(spark, sf_dir):
    return dailylog.default_pair(day_lines(spark, sf_dir), ai_days(spark, sf_dir))


# ---- history ------------------------------------------------------------------------------------------------------------------

_START, _END = "1996-01-01", "1997-06-30"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 10).cast("string")).alias("project_id"), F.col("o_orderkey").cast("string").alias("hash"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        F.when(F.col("o_orderkey") % 97 != 0, F.lit("x")).alias("parent"), F.col("o_orderkey").alias("ord"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the project of their commit, which the join with the window's commits brings."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("hash"), F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".cs")).alias("path"),
        F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"), F.least(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")).alias("modified"),
        (F.col("l_returnflag") == "R").alias("binary"),
    )


def _bounds() -> tuple:
    return F.unix_seconds(F.lit(_START).cast("timestamp")), F.unix_seconds(F.lit(_END).cast("timestamp"))


HIST = f"""c AS (SELECT 'r' || CAST(o_custkey % 10 AS VARCHAR) AS project_id, CAST(o_orderkey AS VARCHAR) AS hash, o_orderdate AS cts, o_orderkey AS ord FROM orders),
w AS (SELECT * FROM c WHERE cts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}'),
f AS (SELECT project_id, 'src/f' || CAST(l_partkey AS VARCHAR) || '.cs' AS path, sum(CAST(l_quantity AS BIGINT)) AS added, sum(CAST(l_linenumber AS BIGINT)) AS deleted,
  sum(least(CAST(l_quantity AS BIGINT), l_linenumber)) AS modified, bool_or(l_returnflag = 'R') AS "binary" FROM lineitem JOIN w ON hash = CAST(l_orderkey AS VARCHAR) GROUP BY ALL),
p AS (SELECT project_id, count(*) FILTER (cts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}') AS commits FROM c GROUP BY ALL),
t AS (SELECT p.project_id, commits, count(path) AS changed_files, count(*) FILTER ("binary") AS binary_files, coalesce(sum(added), 0) AS added, coalesce(sum(deleted), 0) AS deleted,
  coalesce(sum(modified), 0) AS modified, coalesce(sum(added), 0) - coalesce(sum(deleted), 0) AS net FROM p LEFT JOIN f USING (project_id) GROUP BY ALL)"""


@query(f"WITH {HIST} SELECT *, added + deleted AS churn FROM f")
def git_activity(spark, sf_dir):
    start, end = _bounds()
    return history.activity(commits(spark, sf_dir), changes(spark, sf_dir), start, end)


@query(f"WITH {HIST} SELECT project_id, arg_min(hash, ord) FILTER (cts < TIMESTAMP '{_START}') AS hash FROM c GROUP BY project_id")
def git_net_baseline(spark, sf_dir):
    return history.baseline(commits(spark, sf_dir), _bounds()[0])


def history_rows(spark, sf_dir, mode="Activity"):
    """Files, a row each, are kept: projects and totals are counted from them, and each use would join all changes again."""
    start, end = _bounds()
    files = history.file_sums(commits(spark, sf_dir), changes(spark, sf_dir), start, end).persist(StorageLevel.MEMORY_AND_DISK)
    return files, history.project_totals(commits(spark, sf_dir), files, start, end, mode)


@query(f"WITH {HIST} SELECT * FROM t")
def git_project_totals(spark, sf_dir):
    return history_rows(spark, sf_dir)[1]


_GRAND = "count(*) AS projects, 0 AS incomplete, {commits} AS commits, " + ", ".join(f"sum({c}) AS {c}" for c in ("changed_files", "binary_files", "added", "deleted", "modified", "net"))


@query(f"WITH {HIST} SELECT 'Activity' AS mode, {_GRAND.format(commits='sum(commits)')} FROM t UNION ALL SELECT 'NetChange', {_GRAND.format(commits='NULL')} FROM t")
def git_totals(spark, sf_dir):
    both = [history.grand_totals(history_rows(spark, sf_dir, m)[1], m).withColumn("mode", F.lit(m)) for m in ("Activity", "NetChange")]
    return both[0].unionByName(both[1])


@query(f"""WITH {HIST}
SELECT project_id AS project, 'OK' AS status, commits, changed_files, binary_files, path, f.added, f.deleted, f.modified, f.added - f.deleted AS net, f."binary",
  CASE WHEN path IS NULL THEN 'ProjectStatus' ELSE 'File' END AS record_type FROM t LEFT JOIN f USING (project_id)
UNION ALL SELECT 'All projects', CAST(count(*) AS VARCHAR) || ' projects; 0 incomplete/unavailable', sum(commits), sum(changed_files), sum(binary_files), '', sum(added), sum(deleted), sum(modified), sum(net), NULL, 'Totals' FROM t""")
def export_with_status(spark, sf_dir):
    files, projects = history_rows(spark, sf_dir)
    return history.export_rows(projects.withColumn("status", F.lit("OK")), files, history.grand_totals(projects))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
k AS (SELECT doc_id, n, (n + doc_id) % 7 AS k FROM l), b AS (SELECT *, sum(CASE WHEN k = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM k),
m AS (SELECT doc_id, block, least(count(*) FILTER (k < 2 OR k = 5), count(*) FILTER (k IN (2, 3))) AS m FROM b GROUP BY ALL)
SELECT doc_id, CAST(sum(m) AS BIGINT) AS modified FROM m GROUP BY doc_id""")
def modified_estimate(spark, sf_dir):
    """A document's lines as a patch: each is deleted, added or context by its place; a note on a missing line end does not end a block, nor counts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("a"))

    def line(x: Column, n: Column) -> Column:
        k = (n + F.col("doc_id")) % 7
        sign = F.when(k < 2, "-").when(k < 4, "+").when(k == 4, " ").when(k == 5, "-").otherwise("\\ No newline at end of file")
        return F.concat(sign, x)

    patch = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n"), F.array_join(F.transform("a", line), "\n"))
    return history.modified_estimate(d.select("doc_id", patch.alias("patch")), ["doc_id"])


# ---- text -----------------------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT l_partkey, CAST(sum(l_extendedprice) * power(10, l_partkey % 6 - 3) AS DOUBLE) AS n FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, CASE WHEN n >= 1e9 THEN printf('%.2fB', n / 1e9) WHEN n >= 1e6 THEN printf('%.1fM', n / 1e6) WHEN n >= 1e3 THEN printf('%.1fK', n / 1e3)
  ELSE printf('%.0f', floor(n + 0.5)) END AS text FROM (SELECT l_partkey, round(n, 0) + 0.3 AS n FROM x)""")
def format_tokens(spark, sf_dir):
    # Decimals: a sum of doubles depends on the order of addition, which decides what lies half-way between two texts.
    scale = F.pow(F.lit(10.0), F.col("l_partkey") % 6 - 3).cast("decimal(6,3)")
    n = F.round(F.sum(F.col("l_extendedprice").cast("decimal(20,6)")) * scale, 0).cast("double") + 0.3
    x = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(n.alias("n"))
    return x.select("l_partkey", S.token_text(F.col("n")).alias("text"))


@query("""WITH x AS (SELECT l_suppkey, CAST(count(*) % 3 AS BIGINT) AS sessions, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE sum(CAST(round(l_extendedprice * 100) AS BIGINT)) END AS cents, l_suppkey % 2 = 0 AS part FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN sessions = 0 OR (cents = 0 AND part) THEN '—' ELSE '$' || format('{:,}', CAST(cents // 100 AS BIGINT)) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || CASE WHEN part THEN '*' ELSE '' END END AS text FROM x""")
def cost_texts(spark, sf_dir):
    """What a table shows of a cost: a dash without sessions or without any known price, a star where some prices are unknown."""
    s = F.col("l_suppkey")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    x = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.count(F.lit(1)) % 3).alias("sessions"), F.when(s % 5 == 0, 0).otherwise(cents).alias("cents"))
    return x.select("l_suppkey", S.cost_text(F.col("sessions"), F.col("cents") / 100, s % 2 == 0).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN v IS NULL THEN '—' WHEN v > 0 THEN '+' || format('{:,}', v) WHEN v < 0 THEN '-' || format('{:,}', -v) ELSE '0' END AS signed,
  CASE WHEN v IS NULL THEN '—' ELSE '$' || format('{:,.2f}', CAST(v AS DOUBLE)) END AS currency, CASE WHEN v IS NULL THEN '—' ELSE format('{:,}', v) END AS number,
  CASE WHEN v IS NULL THEN '—' WHEN v > 0 THEN '+$' || format('{:,.2f}', CAST(v AS DOUBLE)) WHEN v < 0 THEN '-$' || format('{:,.2f}', CAST(-v AS DOUBLE)) ELSE '$0.00' END AS signed_currency,
  CASE WHEN v IS NULL THEN '—' WHEN v > 0 THEN '+' || printf('%.1f%%', v * 100.0) WHEN v < 0 THEN '-' || printf('%.1f%%', -v * 100.0) ELSE '0.0%' END AS percent
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey * (o_orderkey % 3 - 1) AS BIGINT) END AS v FROM orders)""")
def format_deltas(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") * (F.col("o_orderkey") % 3 - 1))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.signed_text(v).alias("signed"), S.currency_text(v).alias("currency"), S.number_text(v).alias("number"), S.signed_currency_text(v).alias("signed_currency"), S.percent_text(v).alias("percent")
    )


@query("""WITH t AS (SELECT doc_id, list_extract(['=', '+', '-', '@', chr(9), 'x"', '<b>&'], CAST(doc_id % 7 AS INT) + 1) || coalesce(text, '') AS s FROM documents)
SELECT doc_id, '"' || replace(CASE WHEN doc_id % 7 < 5 THEN chr(39) || s ELSE s END, '"', '""') || '"' AS cell,
  replace(replace(replace(replace(s, '&', '&#38;'), '<', '&#60;'), '>', '&#62;'), '"', '&#34;') AS html FROM t""")
def csv_guard_html_escape(spark, sf_dir):
    first = F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", "\t", 'x"', "<b>&"])), (F.col("doc_id") % 7 + 1).cast("int"))
    s = F.concat(first, F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", S.csv_cell(S.formula_guard(s)).alias("cell"), S.html_escape(s).alias("html"))


@query(f"WITH {AGENT} SELECT day, hour, model, round(sum(cost), 9) AS cost FROM acube GROUP BY ALL")
def payload_hours(spark, sf_dir):
    """The cube through the nested document of the page and back."""
    cube = usage.totals(priced_cube(spark, sf_dir), "day", "hour", "model")
    doc = sinks.hours_map(cube, F.col("model"), reports.AGENT_VECTOR)
    hours = doc.select(F.explode("hours").alias("day", "h")).select("day", F.explode("h").alias("hour", "k"))
    return hours.select("day", "hour", F.explode("k").alias("model", "v")).select("day", "hour", "model", F.round(F.col("v")[6], 9).alias("cost"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hourly cost cube of all agents with each day's partial flag."""
    cube = priced_cube(spark, sf_dir)
    days = usage.totals(cube, "day").select("day", usage.partial_flag().alias("cost_partial"))
    return cube.join(days, "day")


ACUBE_DAY = f"aday AS (SELECT day, {MEASURES} FROM acube GROUP BY day)"


def timeline_sql() -> str:
    """The SQL of the daily timeline, as a subquery."""
    return ORACLES["daily_timeline"]


from . import readers, trees  # noqa: E402, F401  fill QUERIES and ORACLES

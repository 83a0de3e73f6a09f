"""The usage report: pages of the assistant, of each agent and of all agents, and the dashboard around them.

One job writes the rows of all pages (``sources.pages``).  To the driver come totals of agents, one row of statistics and the list of files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import scalars as S
from ..operators import usage
from ..sources import pages

CLAUDE_VECTOR = ["input", "cw5m", "cw1h", "cr", "output", "requests", "thinking"]
AGENT_VECTOR = ["input", "cw", "cr", "output", "requests", "thinking", "cost", "cost_tokens"]
CLAUDE_SESSION = ["id", "start", "end", "requests", "input", "cw5m", "cw1h", "cr", "output", "cwd", "branch", "top_model"]
AGENT_SESSION = ["agent", "id", "start", "end", "cwd", "top_key", *AGENT_VECTOR]
AGENT_FORM, CLAUDE_FORM = ["keys", "hours", "sessions"], ["rates", "models", "hours", "sessions", "appBasis"]
ALL, ASSISTANT = "all", "report"


def agent_sections(cube: DataFrame, sessions: DataFrame) -> DataFrame:
    """Keys, hours and sessions of each agent's page and of the page of all, in the order the pages hold them."""
    pages_of = lambda df: df.withColumn("tab", F.explode(F.array(F.lit(ALL), "agent")))
    tab, key = F.col("tab"), F.concat("agent", F.lit("::"), "model")
    vector = F.array(*[F.col(c).cast("double") for c in AGENT_VECTOR])
    cells, told = pages_of(cube), pages_of(sessions)
    keys = cells.select("tab", key.alias("k")).distinct()
    return (
        pages.section(keys, tab, "keys", pages.json_row(F.col("k")), text1=F.col("k"))
        .unionByName(pages.section(cells, tab, "hours", pages.json_row(F.col("day"), F.col("hour"), key, vector), F.col("day"), F.col("hour"), text2=key))
        .unionByName(pages.section(told, tab, "sessions", pages.json_row(*map(F.col, AGENT_SESSION)), None, F.col("start"), F.col("first_pos")))
    )


def claude_sections(report: dict[str, DataFrame]) -> DataFrame:
    """Rates, models, hours, sessions and the sums over all copies of the assistant's own page."""
    cube, tab = report["cube"], F.lit(ASSISTANT)
    models = cube.select("model").distinct()
    rates = models.join(F.broadcast(dims.claude_rates(cube.sparkSession)), "model", "left")  # 15 rows
    rate = F.when(F.col("r_in").isNotNull(), F.array("r_in", "r_out", "r_cr", "r_cw5m", "r_cw1h"))
    model, vector = F.col("model"), F.array(*[F.col(c).cast("double") for c in CLAUDE_VECTOR])
    parts = [
        pages.section(rates, tab, "rates", pages.json_row(model, rate), model),
        pages.section(models, tab, "models", pages.json_row(model), model),
        pages.section(cube, tab, "hours", pages.json_row(F.col("day"), F.col("hour"), model, vector), F.col("day"), F.col("hour"), text2=model),
        pages.section(report["sessions"], tab, "sessions", pages.json_row(*map(F.col, CLAUDE_SESSION)), None, F.col("start"), F.col("first_pos")),
        pages.section(report["basis"], tab, "appBasis", pages.json_row(model, vector), model),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def claude_meta(report: dict[str, DataFrame]) -> dict:
    one, counts = report["summary"].drop("models").first(), report["stats"].first()
    return {
        "rawRecords": counts.raw, "countedRecords": counts.counted, "duplicateRecords": counts.duplicates, "partialRecords": counts.partials,
        "inflation": counts.inflation, "firstTs": one.first_ts, "lastTs": one.last_ts, "sessions": one.sessions, "unknownModels": one.unknown_models,
    }


def publish(out: str, report: dict[str, DataFrame], labels: dict[str, str], tz: str, claude: dict[str, DataFrame] | None = None, page_rows: int = pages.PAGE_ROWS) -> list[str]:
    """Write the report to the folder ``out``, shared by driver and executors; returns the pages' names.

    ``labels``: agents that were loaded, in the order of their tabs.  An agent without rows has no page, but is named.
    """
    rows = agent_sections(report["cube"], report["sessions"])
    sums = report["totals"].select("agent", S.token_text(usage.real_tokens()).alias("tokens"), F.concat(F.format_number(usage.real_tokens(), 0), F.lit(" tokens, "), S.currency_text(F.col("cost"))).alias("shown"))
    told = {r.agent: r for r in sums.collect()}  # a row an agent
    here = [a for a in labels if a in told]
    meta = {ALL: {"meta": {"title": "All agents", "tz": tz}, "agents": labels}}
    meta |= {a: {"meta": {"title": labels[a], "tz": tz}, "agents": {a: labels[a]}} for a in here if a != "claude" or claude is None}
    if claude is not None:
        rows = rows.where("tab <> 'claude'").unionByName(claude_sections(claude))
        meta[ASSISTANT] = {"meta": {"title": labels["claude"], "tz": tz} | claude_meta(claude)}
    pages.write(rows, out, meta, page_rows)
    names = {ALL: "agents/all.html"} | {a: "report.html" if a == "claude" and claude is not None else f"agents/{a}.html" for a in here}
    lines = [(labels.get(a, "all"), told[a].shown) for a in [*here, None] if a in told]
    for a, name in names.items():
        pages.write_page(out, ASSISTANT if name == "report.html" else a, name, "All agents" if a == ALL else labels[a], lines if a == ALL else [(labels[a], told[a].shown)])
    badge = lambda a: told[a].tokens if a in told else "0"
    pages.write_dashboard(out, [(ALL, "All agents", names[ALL], badge(None)), *[(a, labels[a], names[a], badge(a)) for a in here]])
    pages.write_single(out, ALL, AGENT_FORM, os.path.join(out, "agents.html"), "All agents", lines)
    kept = {*names.values(), "dashboard.html", "agents.html"}
    for folder in ("", "agents"):  # pages of agents that are gone
        for name in os.listdir(os.path.join(out, folder)):
            if name.endswith(".html") and os.path.join(folder, name) not in kept:
                os.remove(os.path.join(out, folder, name))
    return sorted(kept)

"""The daily log: a scan's lines a day and project, assistant usage a day; timelines with carry-forward, comparisons.

Tables: lines (date, project_id, name, scanned_at, scope, tokenizer, files, bytes, tokens, physical, blank, code,
comment, content); languages (date, project_id, language, category, physical, code); ai (date, tokens, cost,
cost_partial), a row a day; ai_projects (date, project_id, tokens, cost, cost_partial).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import usage

TOTALS = ["files", "bytes", "tokens", "physical", "blank", "code", "comment", "content"]


def record_lines(log: DataFrame, scanned: DataFrame) -> DataFrame:
    """The newest scan of a project on a day stays."""
    both = log.unionByName(scanned)
    return both.groupBy("date", "project_id").agg(F.max_by(F.struct(*both.columns), "scanned_at").alias("e")).select("e.*")


def record_ai(old: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """Today is always replaced, a past day only by at least as many tokens; days that are not new stay."""
    fields = [c for c in old.columns if c != "date"]
    o = old.select("date", F.struct(*fields).alias("o"))
    n = new.select("date", F.struct(*fields).alias("n"))
    take = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("date") == today) | (F.col("n.tokens") >= F.col("o.tokens")))
    both = o.join(n, "date", "full_outer").withColumn("v", F.when(take, F.col("n")).otherwise(F.col("o")))
    return both.select("date", *[F.col(f"v.{c}").alias(c) for c in fields])


def ai_rows(cube: DataFrame) -> DataFrame:
    """(date, tokens, cost, cost_partial): what a usage load says of each day, from the priced cube of all agents."""
    days = usage.totals(cube, "day")
    return days.select(F.col("day").alias("date"), usage.real_tokens().alias("tokens"), "cost", usage.partial_flag().alias("cost_partial"))


def ai_project_rows(priced: DataFrame, roots: DataFrame, tz: str = "UTC") -> DataFrame:
    """(date, project_id, tokens, cost, cost_partial): each day's records by the project whose folder the session was in."""
    days = priced.withColumn("agent", F.concat(S.day_key(F.col("ts"), tz), F.lit(" "), "agent"))  # a session counts on each of its days
    sessions = usage.agent_sessions(days)
    by_day = usage.project_sessions(sessions, roots).withColumn("date", F.substring("agent", 1, 10)).groupBy("date", "project_id")
    sums = by_day.agg(*[F.sum(c).alias(c) for c in usage.AGENT_MEASURES])
    return sums.select("date", "project_id", usage.real_tokens().alias("tokens"), "cost", usage.partial_flag().alias("cost_partial"))


def chosen(df: DataFrame, projects: list[str] | None) -> DataFrame:
    return df if projects is None else df.where(F.col("project_id").isin(projects))


def effective(lines: DataFrame, date: str | Column, projects: list[str] | None = None) -> DataFrame:
    """Each project's latest entry up to the date, and whether it is carried from an earlier day."""
    date = F.lit(date) if isinstance(date, str) else date
    rows = chosen(lines, projects).where(F.col("date") <= date)
    last = rows.groupBy("project_id").agg(F.max_by(F.struct(*rows.columns), F.struct("date", "scanned_at")).alias("e")).select("e.*")
    return last.withColumn("is_carried", F.col("date") != date)


def contract() -> Column:
    return F.concat_ws("/", "scope", F.lower("tokenizer"))


def contracts(entries: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(entries)), "+")


def ai_by_day(ai: DataFrame, ai_projects: DataFrame | None, projects: list[str] | None, all_agents: bool) -> DataFrame:
    """(date, ai_tokens, ai_cost, ai_partial): the whole machine, or the chosen projects' part (zeros without a match)."""
    if all_agents or projects is None:
        return ai.select("date", F.col("tokens").alias("ai_tokens"), F.col("cost").alias("ai_cost"), F.col("cost_partial").alias("ai_partial"))
    part = chosen(ai_projects, projects).groupBy("date").agg(F.sum("tokens").alias("t"), F.sum("cost").alias("c"), F.bool_or("cost_partial").alias("p"))
    return ai.select("date").join(part, "date", "left").select(
        "date", F.coalesce("t", F.lit(0.0)).alias("ai_tokens"), F.coalesce("c", F.lit(0.0)).alias("ai_cost"), F.coalesce("p", F.lit(False)).alias("ai_partial")
    )


def timeline(lines: DataFrame, ai: DataFrame, ai_projects: DataFrame | None = None, projects: list[str] | None = None, all_agents: bool = True) -> DataFrame:
    """A row a day that has a scan or assistant tokens, with totals over each project's latest entry.

    Instead of a grid of days and projects, each scan adds its difference to the project's scan before it; a day's totals are
    running sums of the differences.  Contracts are counted the same way.  The windows over days hold a row a day.
    """
    rows = chosen(lines, projects)
    before = Window.partitionBy("project_id").orderBy("date")
    rows = rows.withColumn("contract", contract())
    steps = rows.select(
        "date", "project_id", "contract",
        *[(F.col(c) - F.coalesce(F.lag(c).over(before), F.lit(0))).alias(c) for c in TOTALS],
        F.when(F.lag("date").over(before).isNull(), 1).otherwise(0).alias("new"),
        F.lag("contract").over(before).alias("was"),
    )
    scans = steps.groupBy("date").agg(F.count(F.lit(1)).alias("scanned"), F.sum("new").alias("new"), *[F.sum(c).alias(c) for c in TOTALS])
    # A contract is in use on a day while more projects took it up than left it.
    moves = steps.select("date", F.col("contract"), F.lit(1).alias("n")).unionByName(
        steps.where("was is not null").select("date", F.col("was").alias("contract"), F.lit(-1).alias("n"))
    )
    moves = moves.groupBy("date", "contract").agg(F.sum("n").alias("n"))
    ai_day = ai_by_day(ai, ai_projects, projects, all_agents)
    days = scans.join(ai_day, "date", "full_outer")
    by_day = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = days.select(
        "date", F.coalesce("scanned", F.lit(0)).alias("scanned"), "ai_tokens", "ai_cost", "ai_partial",
        F.sum("new").over(by_day).alias("projects"),
        *[F.sum(c).over(by_day).alias(c) for c in TOTALS],
    )
    running = Window.partitionBy("contract").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = Window.partitionBy("contract").orderBy("date")
    spans = moves.withColumn("open", F.sum("n").over(running)).withColumn("until", F.lead("date").over(ends)).where("open > 0")
    in_use = sums.select("date").join(
        spans.select("contract", F.col("date").alias("since"), "until"),
        (F.col("date") >= F.col("since")) & (F.col("until").isNull() | (F.col("date") < F.col("until"))),
    )
    used = in_use.groupBy("date").agg(contracts(F.col("contract")).alias("contract"))
    shown = sums.join(used, "date", "left").where((F.col("scanned") > 0) | (F.coalesce("ai_tokens", F.lit(0.0)) > 0))
    prior = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(prior)
    changed = F.contains("contract", F.lit("+")) | (last("contract").isNotNull() & (F.col("contract") != last("contract")))
    return shown.select(
        "date", F.coalesce("projects", F.lit(0)).alias("projects"), (F.coalesce("projects", F.lit(0)) - F.col("scanned")).alias("carried"),
        *TOTALS, *[(F.col(c) - last(c)).alias(f"delta_{c}") for c in ("physical", "code", "tokens")],
        "ai_tokens", "ai_cost", "ai_partial", F.coalesce(changed, F.lit(False)).alias("scope_changed"),
    )


def notes(rows: DataFrame) -> DataFrame:
    some = F.format_string("%d of %d projects from earlier days", F.col("carried"), F.col("projects"))
    text = F.concat_ws(
        " • ",
        F.when(F.col("physical").isNull(), "Not scanned yet")
        .when(F.col("carried") == F.col("projects"), "Not scanned this day; latest earlier scan shown")
        .when(F.col("carried") > 0, some),
        F.when(F.col("scope_changed"), "Counting scope or tokenizer changed"),
    )
    return rows.withColumn("notes", text)


# The metrics of a comparison, the column each is read from, and whether it is money.
COMPARED = [
    ("Files", "files", False),
    ("Physical lines", "physical", False),
    ("Code lines", "code", False),
    ("Comment lines", "comment", False),
    ("Blank lines", "blank", False),
    ("Content lines", "content", False),
    ("Tokens", "tokens", False),
    ("AI tokens (that day)", "ai_tokens", False),
    ("AI cost (that day)", "ai_cost", True),
]


def _day_totals(lines, ai_day, date, projects):
    sums = effective(lines, date, projects).agg(*[F.sum(c).cast("double").alias(c) for c in TOTALS])
    day = ai_day.where(F.col("date") == date).agg(F.first("ai_tokens").alias("ai_tokens"), F.first("ai_cost").alias("ai_cost"))
    return sums, day


def compare_metrics(lines: DataFrame, ai: DataFrame, date_a: str, date_b: str, ai_projects: DataFrame | None = None, projects: list[str] | None = None, all_agents: bool = True) -> DataFrame:
    """(ord, metric, a, b, delta, delta_percent, is_currency): what is unknown on a day is null, and so is its difference."""
    ai_day = ai_by_day(ai, ai_projects, projects, all_agents)
    columns = []
    frame = None
    for side, date in (("a", date_a), ("b", date_b)):
        for part in _day_totals(lines, ai_day, date, projects):
            part = part.select([F.col(c).alias(f"{side}_{c}") for c in part.columns])
            frame = part if frame is None else frame.join(F.broadcast(part))  # one row each
    for i, (name, column, money) in enumerate(COMPARED):
        columns.append(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("metric"), F.col(f"a_{column}").alias("a"), F.col(f"b_{column}").alias("b"), F.lit(money).alias("is_currency")))
    rows = frame.select(F.explode(F.array(*columns)).alias("r")).select("r.*")
    delta = F.col("b") - F.col("a")
    return rows.withColumn("delta", delta).withColumn("delta_percent", F.when(F.col("a") != 0, delta / F.col("a")))


def compare_languages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines and code of two days by language and category, zeros for a missing side, most lines first."""
    keys = ["language", "category"]
    side = lambda df, s: df.groupBy(*keys).agg(F.sum("physical").alias(f"lines_{s}"), F.sum("code").alias(f"code_{s}"))
    both = side(a, "a").join(side(b, "b"), keys, "full_outer").na.fill(0)
    both = both.withColumn("delta_lines", F.col("lines_b") - F.col("lines_a")).withColumn("delta_code", F.col("code_b") - F.col("code_a"))
    return both.orderBy(F.greatest("lines_a", "lines_b").desc(), "language")


def warnings(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: contracts of both days, whether they differ, and which days carry entries; ``a``, ``b``: effective rows."""
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    return both.agg(
        contracts(contract()).alias("contracts"),
        (F.count_distinct(contract()) > 1).alias("differ"),
        F.coalesce(F.bool_or(F.col("is_carried") & (F.col("side") == "a")), F.lit(False)).alias("carried_a"),
        F.coalesce(F.bool_or(F.col("is_carried") & (F.col("side") == "b")), F.lit(False)).alias("carried_b"),
    )


def compare_text(rows: DataFrame) -> DataFrame:
    money = F.col("is_currency")
    text = lambda c: F.when(money, S.currency_text(F.col(c))).otherwise(S.number_text(F.col(c)))
    delta = F.when(money, S.signed_currency_text(F.col("delta"))).otherwise(S.signed_text(F.col("delta")))
    return rows.select("ord", "metric", text("a").alias("a_text"), text("b").alias("b_text"), delta.alias("delta_text"), S.percent_text(F.col("delta_percent")).alias("percent_text"))


def days_newest_first(lines: DataFrame, ai: DataFrame) -> DataFrame:
    return lines.select("date").unionByName(ai.select("date")).distinct().orderBy(F.desc("date"))


def default_pair(lines: DataFrame, ai: DataFrame) -> DataFrame:
    """The two most recent days, what a comparison starts with."""
    return days_newest_first(lines, ai).limit(2)

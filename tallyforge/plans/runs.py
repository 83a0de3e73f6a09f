"""Whole runs: a scan of projects, a usage report, a history report.  One job each over all projects or sources."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import scalars as S
from ..operators import dailylog, history, lines, metrics, paths, usage
from ..sources import agents, registry, sinks, tree
from . import publication, reports
from ..sources import repos as git_repos


def scanned(
    spark: SparkSession, roots: dict[str, str], scope: str = "SourceOnly", excludes: list[str] = dims.DEFAULT_EXCLUSIONS, own: list = (), tokens=None, max_bytes: int = dims.MAX_FILE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(files, told): metrics of every file that counts, with a ``warning`` instead of them where a file cannot be measured;
    and warnings of folders.  One listing each; contents are read of chosen files only, once."""
    listed = tree.listing(spark, roots, list(excludes), {p: list(patterns) for p, patterns in own}, max_bytes)
    found = paths.classify(listed.where("state = 'file'").select("project_id", "path", "size"), scope)
    read = tree.with_contents(found, roots, max_bytes)
    read = read.where(F.col("content").isNull() | ~lines.looks_binary(F.col("content"))).withColumn("text", lines.decode_text(F.col("content")))
    warning = F.when(F.col("size") > max_bytes, "larger than the size limit").when(F.col("content").isNull(), "not readable").when(F.col("text").isNull(), "not decodable")
    read = read.withColumn("warning", warning).drop("content").withColumn("tokens", tokens(F.col("text")) if tokens else F.lit(0).cast("long"))
    columns = ["project_id", "path", "language", "category", F.col("size").alias("bytes"), "tokens", *lines.METRICS, S.extension_text(F.col("path")).alias("extension"), "warning"]
    files = lines.line_metrics(read).select(*columns)
    said = F.create_map(*[F.lit(x) for pair in {"repository": "nested repository skipped", "unlisted": "not listable", "absent": "folder not found"}.items() for x in pair])
    return files, listed.where("state <> 'file'").select("project_id", "path", said[F.col("state")].alias("warning"))


def scan(
    spark: SparkSession, roots: dict[str, str], scope: str = "SourceOnly", excludes: list[str] = dims.DEFAULT_EXCLUSIONS, own: list = (), tokens=None, max_bytes: int = dims.MAX_FILE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(file metrics, warnings) of all projects.  ``own``: (project, patterns); ``tokens``: a function from a text column to its token count."""
    files, told = scanned(spark, roots, scope, excludes, own, tokens, max_bytes)
    warnings = told.unionByName(files.where("warning is not null").select("project_id", "path", "warning"))
    # A sort samples what it sorts: dealt out first, the measured rows are sampled and no file is opened again.
    order = lambda df, *keys: df.repartition("project_id", "path").orderBy("project_id", *keys)
    return order(files.where("warning is null").drop("warning"), F.upper("path")), order(warnings, "path")


def load_sources(sources: dict[str, Callable[[], DataFrame]], disabled: set[str] = frozenset(), loaded: list | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Records of all agents and each one's status; a source that fails is left out and told, the others go on.  ``loaded`` gets the cached frames.

    Spark reads late, so each source is written to the cache inside its own try.
    """
    frames, status = [], {}
    for agent, load in sources.items():
        if agent in disabled:
            status[agent] = "Disabled"
            continue
        try:
            frame = load().cache()
            status[agent] = "Loaded" if frame.count() else "Empty"
            frames.append(frame)
        except Exception as error:  # noqa: BLE001  told in the status
            status[agent] = f"Failed: {type(error).__name__}"
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    if loaded is not None:
        loaded += frames
    return out, status


def unload(found: dict) -> None:
    """Let go of what ``usage_of`` or ``history_report`` has loaded, when nothing reads it any more."""
    for frame in found.get("loaded", ()):
        frame.unpersist()


def usage_report(records: DataFrame, tz: str = "UTC", since: int | None = None, until: int | None = None) -> dict[str, DataFrame]:
    """Cube and sessions of agent records: window, first copy of each request, prices."""
    kept = usage.with_agent_cost(usage.keep_first(usage.in_window(records, since, until)))
    cube = usage.agent_cube(kept, tz)
    return {"cube": cube, "sessions": usage.agent_sessions(kept), "totals": usage.rolled_up(cube)}


def claude_report(records: DataFrame, tz: str = "UTC", since: int | None = None, until: int | None = None, dedupe: bool = True) -> dict[str, DataFrame]:
    rows = usage.in_window(records, since, until)
    kept = usage.best_copies(rows) if dedupe else rows.withColumnRenamed("ord", "pos")
    return {
        "stats": usage.dedup_stats(rows, dedupe), "basis": usage.app_basis(rows), "cube": usage.hourly_cube(kept, tz),
        "sessions": usage.claude_sessions(kept), "summary": usage.summary(kept),
    }


def history_report(
    spark: SparkSession, repos: dict[str, str], start: int, end: int, scope: str = "SourceOnly", rules: DataFrame | None = None, mode: str = "Activity"
) -> dict[str, DataFrame]:
    """Changes of all repositories between two times (epoch seconds): of every commit (Activity), or from the last commit
    before the window to the last one in it (NetChange)."""
    net = mode == "NetChange"
    commits, diffs = git_repos.read_history(spark, repos, start, end, net)
    keys = ["project_id", "hash"]

    def counting(df: DataFrame, column: str, flag: str) -> DataFrame:
        if rules is None:  # told by the path alone, row by row
            marked = paths.classified(df, scope, column, flag)
            return marked.withColumn(flag, F.col(flag) & F.col(column).isNotNull()).drop("language", "category")
        some = df.select("project_id", F.col(column).alias("path")).where("path is not null").distinct()
        good = paths.classify(some, scope)
        if rules is not None:
            marks = paths.ignored(good.withColumn("is_dir", F.lit(False)), rules, ["project_id", "path"])
            good = good.join(marks.where("not ignored"), ["project_id", "path"], "left_semi")
        good = good.select("project_id", F.col("path").alias(column), F.lit(True).alias(flag))
        return df.join(good, ["project_id", column], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))

    entries = counting(counting(history.numstat_entries(diffs, "renames"), "path", "counts"), "old_path", "old_counts")
    plain = counting(history.numstat_entries(diffs.where("plain <> ''"), "plain"), "path", "counts")
    changes = history.split_renames(entries, plain, keys)
    # Each file's part of the patch, by the name it has after the change.
    parts = diffs.select(*keys, F.explode(F.split("patch", r"(?m)^(?=diff --git )", -1)).alias("patch")).where("patch <> ''")
    parts = parts.withColumn("path", F.regexp_extract("patch", r"(?m)^\+\+\+ (?:b/)?(.*?)\t?$", 1))
    modified = history.modified_estimate(parts.where("path <> '/dev/null'"), [*keys, "path"])
    changes = changes.join(modified, [*keys, "path"], "left").na.fill(0, ["modified"])
    files = history.activity(commits, changes, start, end, None if net else commits.where("shallow").select("project_id").distinct())
    totals = history.project_totals(commits, files, start, end, mode)
    known = commits.groupBy("project_id").agg(
        F.max_by("hash", F.when(F.col("ts") <= end, -F.col("ord"))).alias("head"), F.bool_or("shallow").alias("_shallow"), F.count_if(F.col("ts").between(start, end)).alias("_n"),
        F.bool_or(F.col("parent").isNull() & F.col("ts").between(start, end)).alias("_edge"), F.bool_or(F.col("ts") < start).alias("_base"),
    )
    said = history.status(F.col("_n"), F.col("_shallow"), F.col("_edge"), F.col("_base"), mode)
    projects = totals.join(known, "project_id").withColumn("status", said).drop("_shallow", "_n", "_edge", "_base")
    grand = history.grand_totals(projects, mode, "status is not null and status <> 'No commits'")
    return {"files": files, "projects": projects, "totals": grand, "loaded": [commits, diffs]}


def history_export(report: dict[str, DataFrame], path: str, branch: str, start: int, end: int, mode: str = "Activity", scope: str = "SourceOnly") -> None:
    """The report as one CSV file of 18 columns."""
    rows = history.export_rows(report["projects"], report["files"], report["totals"])
    heads = report["projects"].select(F.col("project_id").alias("project"), "head")
    lines = sinks.history_csv(rows.join(heads, "project", "left"), branch, "", start, end, mode, scope)
    sinks.write_csv_file(lines, path, sinks.head(sinks.HISTORY_COLUMNS))


def record_day(files: DataFrame, names: DataFrame, log: DataFrame | None, day: str, scanned_at: int, scope: str, tokenizer: str) -> DataFrame:
    """The daily log's lines with a scan's file metrics put in: a row a project and day, the newest scan of the day.

    ``names``: (project_id, name); projects without files get a row of zeros.
    """
    sums = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in dailylog.TOTALS if c != "files"])
    rows = names.join(sums, "project_id", "left").na.fill(0, dailylog.TOTALS).select(
        F.lit(day).alias("date"), "project_id", "name", F.lit(scanned_at).cast("long").alias("scanned_at"), F.lit(scope).alias("scope"), F.lit(tokenizer).alias("tokenizer"),
        *[F.col(c).cast("long").alias(c) for c in dailylog.TOTALS],
    )
    return rows if log is None else dailylog.record_lines(log, rows)


def record_usage(report: dict[str, DataFrame], priced: DataFrame, roots: DataFrame, ai: DataFrame | None, ai_projects: DataFrame | None, today: str, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """The daily log's assistant rows, a row a day and a row a day and project, with a usage load put in.

    Of days that were known, today's is replaced and a past one only by at least as many tokens; a day's project rows go
    with its own row.
    """
    days, parts = dailylog.ai_rows(report["cube"]), dailylog.ai_project_rows(priced, roots, tz)
    if ai is None:
        return days, parts
    taken = days.join(ai.select("date", F.col("tokens").alias("_old")), "date", "left").where((F.col("date") == today) | F.col("_old").isNull() | (F.col("tokens") >= F.col("_old"))).select("date")
    kept = ai_projects.join(taken, "date", "left_anti").unionByName(parts.join(taken, "date", "left_semi"))
    return dailylog.record_ai(ai, days, today), kept


def daily_export(lines: DataFrame, ai: DataFrame, path: str) -> None:
    """The timeline as one CSV file of 17 columns, newest day last."""
    rows = dailylog.notes(dailylog.timeline(lines, ai))
    sinks.write_csv_file(sinks.guarded_csv(rows, sinks.DAILY_COLUMNS).withColumn("_d", F.substring("line", 2, 10)), path, sinks.head(sinks.DAILY_COLUMNS), ["_d"])


def usage_of(spark: SparkSession, where: registry.Home, tz: str = "UTC", disabled: set[str] = frozenset(), extra_transcripts: list[str] = (), out: str | None = None, cache: str | None = None, rescan: bool = False) -> dict:
    """The usage of all agents found: records, each agent's status and the report; pages go to the folder ``out``.

    The assistant's transcripts are deduplicated by best copy, over all time, before they join the others.  With a folder
    ``cache``, files and databases of the size and time they had at the load before are not read again, and of transcripts and rollouts
    that have grown only what was appended.
    """
    found = registry.detect(where)
    folders = [f for f in [*registry.places("claude", where), *extra_transcripts] if os.path.isdir(f)]
    loads: dict[str, Callable[[], DataFrame]] = {}
    counts: dict[str, dict[str, int]] = {}
    loaded: list[DataFrame] = []
    own: list[DataFrame] = []

    def kept(agent: str, load: Callable[[], tuple[DataFrame, dict[str, int]]]) -> DataFrame:
        rows, counts[agent] = load()
        return rows

    def assistant() -> DataFrame:
        rows = kept("claude", lambda: registry.kept_transcripts(spark, folders, cache, rescan)) if cache else registry.transcripts(spark, folders)
        if out:  # read twice, for the records and for the assistant's page
            rows = rows if cache else rows.cache()
            loaded.append(rows)
            own.append(rows)
        return usage.from_claude(rows)

    if folders:
        loads["claude"] = assistant
    for agent, load in registry.LOADERS.items():
        if found[agent] and cache:
            loads[agent] = lambda agent=agent: kept(agent, lambda: registry.kept(spark, agent, where, cache, rescan))
        elif found[agent]:
            loads[agent] = lambda load=load: load(spark, where)
    records, status = load_sources(loads, disabled, loaded)
    status = {agent: status.get(agent, "Disabled" if agent in disabled else "NotFound") for agent in registry.PLACES}
    if records is None:
        return {"status": status, "records": None, "files": counts}
    report = usage_report(records, tz)
    if out:
        labels = dict(agents.AGENTS) | {"claude": "Claude"}
        claude = claude_report(own[0], tz) if own and status["claude"] == "Loaded" else None
        reports.publish(out, report, {a: labels[a] for a in loads}, tz, claude)
    return {"status": status, "records": records, "files": counts, "loaded": loaded} | report


@dataclass
class Project:
    project_id: str
    name: str
    root: str
    enabled: bool = True
    patterns: tuple[str, ...] = ()


def refresh(
    spark: SparkSession, projects: list[Project], state: str, day: str, now: int, scope: str = "SourceOnly", tokenizer: str = "o200k_base", tokens=None,
    where: registry.Home | None = None, tz: str = "UTC", cache: str | None = None,
) -> None:
    """Scan all enabled projects, record the day and the agents' usage, and publish all tables of the folder ``state`` at once.

    Tables: files, warnings, snapshot (a row a project), lines, languages, ai, ai_projects.  A project whose folder is gone keeps its snapshot and
    gets no line.  Contents of files are read once: all tables come from ``files`` as written.  ``now``: epoch milliseconds.
    """
    with publication.Publication(spark, state).draft() as draft:
        scanning = [p for p in projects if p.enabled]
        found, told = scanned(spark, {p.project_id: p.root for p in scanning}, scope, own=[(p.project_id, list(p.patterns)) for p in scanning], tokens=tokens)
        files = draft.write("files", found)
        warnings = draft.write("warnings", told.unionByName(files.where("warning is not null").select("project_id", "path", "warning")))
        files = files.where("warning is null").drop("warning")
        listed = spark.createDataFrame([(p.project_id, p.name, p.root, p.enabled, n) for n, p in enumerate(projects)], "project_id string, name string, root_path string, enabled boolean, ord long")
        absent = warnings.where("path = '' and warning = 'folder not found'").select("project_id")
        here = listed.where("enabled").join(absent, "project_id", "left_anti").select("project_id", "name")

        today = record_day(files, here, None, day, now, scope, tokenizer)
        fresh = today.drop("date")
        old = draft.old("snapshot")
        draft.write("snapshot", fresh if old is None else metrics.merge_snapshot(old, fresh, listed.select("project_id", "ord")))
        log = draft.old("lines")
        draft.write("lines", today if log is None else dailylog.record_lines(log, today))
        languages = metrics.by_language(files, "project_id").select(F.lit(day).alias("date"), "project_id", "language", "category", "physical", "code")
        known = draft.old("languages")
        if known is not None:  # a day's languages go with the day's line
            languages = known.join(here.withColumn("date", F.lit(day)), ["date", "project_id"], "left_anti").select(*languages.columns).unionByName(languages)
        draft.write("languages", languages)
        if where is not None:
            got = usage_of(spark, where, tz, cache=cache)
            if got["records"] is not None:
                priced = usage.with_agent_cost(usage.keep_first(got["records"]))
                ai, parts = record_usage(got, priced, listed.select("project_id", "root_path", "ord"), draft.old("ai"), draft.old("ai_projects"), day, tz)
                draft.write("ai", ai)
                draft.write("ai_projects", parts)
                unload(got)

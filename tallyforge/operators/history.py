"""Version history: lines added, deleted and estimated as modified a file, over a window of commits.

Commits: project_id, hash, ts (seconds), parent, ord (place in the log, newest first).  Changes: project_id, hash, path,
added, deleted, modified, binary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ["added", "deleted", "modified"]


def check_days(days: int) -> int:
    if not 1 <= days <= 36500:
        raise ValueError("days: 1 to 36500")
    return days


def selected(commits: DataFrame, start, end) -> DataFrame:
    return commits.where(F.col("ts").between(start, end))


def activity(commits: DataFrame, changes: DataFrame, start, end, shallow: DataFrame | None = None) -> DataFrame:
    """Sums a file over all commits in the window, most lines first; commits of a shallow clone without a parent are left out.

    ``shallow``: (project_id).  ``changes`` without project_id belong to the project of their commit.
    """
    return by_churn(file_sums(commits, changes, start, end, shallow))


def file_sums(commits: DataFrame, changes: DataFrame, start, end, shallow: DataFrame | None = None) -> DataFrame:
    """``activity`` in no order."""
    chosen = selected(commits, start, end)
    if shallow is not None:
        edge = chosen.where("parent is null").join(shallow, "project_id", "left_semi").select("project_id", "hash")
        chosen = chosen.join(edge, ["project_id", "hash"], "left_anti")
    known = "project_id" in changes.columns
    rows = changes.join(chosen.select("project_id", "hash"), ["project_id", "hash"] if known else "hash", "left_semi" if known else "inner")
    sums = rows.groupBy("project_id", "path").agg(*[F.sum(c).alias(c) for c in SUMS], F.bool_or("binary").alias("binary"))
    return sums.withColumn("churn", F.col("added") + F.col("deleted"))


def by_churn(files: DataFrame) -> DataFrame:
    return files.orderBy("project_id", F.desc("churn"), "path")


def baseline(commits: DataFrame, start) -> DataFrame:
    """(project_id, hash): the first commit of the log that is older than the window; null where there is none."""
    old = F.col("ts") < start
    return commits.groupBy("project_id").agg(F.min_by("hash", F.when(old, F.col("ord"))).alias("hash"))


def project_totals(commits: DataFrame, files: DataFrame, start, end, mode: str = "Activity") -> DataFrame:
    """A row a project: commits (all in the window, whatever their files; unknown for a net change), files and sums."""
    n = commits.groupBy("project_id").agg(F.count_if(F.col("ts").between(start, end)).alias("commits"))
    if mode != "Activity":
        n = n.withColumn("commits", F.lit(None).cast("long"))
    sums = files.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("changed_files"), F.count_if("binary").alias("binary_files"), *[F.sum(c).alias(c) for c in SUMS]
    )
    joined = n.join(sums, "project_id", "left").na.fill(0, ["changed_files", "binary_files", *SUMS])
    return joined.withColumn("net", F.col("added") - F.col("deleted"))


def grand_totals(projects: DataFrame, mode: str = "Activity", incomplete: str = "false") -> DataFrame:
    """One row over all projects; overlapping folders are not deduplicated."""
    commits = F.sum(F.coalesce("commits", F.lit(0))) if mode == "Activity" else F.lit(None).cast("long")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("changed_files", "binary_files", *SUMS, "net")]
    return projects.agg(F.count(F.lit(1)).alias("projects"), F.count_if(F.expr(incomplete)).alias("incomplete"), commits.alias("commits"), *sums)


def status(commits: Column, shallow: Column, boundary: Column, has_baseline: Column, mode: str) -> Column:
    """What a project's row says about its history; null if it is whole."""
    if mode == "Activity":
        return F.when(commits == 0, "No commits").when(shallow & boundary, "Incomplete: shallow boundary excluded").when(shallow, "Incomplete: shallow local history")
    return (
        F.when(commits == 0, "No commits")
        .when(shallow & ~has_baseline, "Unavailable: period starts before available shallow history")
        .when(shallow, "Incomplete: shallow local history")
    )


def split_renames(entries: DataFrame, plain: DataFrame, keys: list[str]) -> DataFrame:
    """Renames across the border of what counts are replaced by the whole files of the diff without renames.

    ``entries``: keys, path, old_path, added, deleted, binary, counts, old_counts; ``plain``: the same diff without renames
    (keys, path, added, deleted, binary, counts).  Only files that count stay.
    """
    crossing = F.col("old_path").isNotNull() & (F.col("counts") != F.col("old_counts"))
    kept = entries.where(~crossing & (F.col("counts") | F.coalesce("old_counts", F.lit(False))))
    moved = entries.where(crossing).select(*keys, F.explode(F.array("path", "old_path")).alias("path"))
    whole = plain.where("counts").join(moved, [*keys, "path"], "left_semi")
    out = [*keys, "path", "added", "deleted", "binary"]
    return kept.select(*out).unionByName(whole.select(*out))


# ---- text from the tool -----------------------------------------------------------------------------------------------------


def numstat_entries(df: DataFrame, output: str = "output", keys: tuple[str, ...] = ("project_id", "hash")) -> DataFrame:
    """(keys, path, old_path, added, deleted, binary) of ``diff --numstat -z`` texts.

    Fields end in NUL; a rename has an empty path and its two names in the next two fields.  A field with two tabs begins an
    entry unless it is the name of a rename, which is told by the two fields before it: a scan over the fields of a row.
    """
    fields = F.filter(F.split(F.col(output), "\x00", -1), lambda x: x != "")
    entry = "array<struct<head:string,old_path:string,path:string>>"
    state = F.struct(F.lit("").alias("head"), F.lit(None).cast("string").alias("old"), F.lit(False).alias("rename"), F.array().cast(entry).alias("out"))

    def add(acc: Column, head: Column, old: Column, path: Column) -> Column:
        return F.concat(acc["out"], F.array(F.struct(head.alias("head"), old.alias("old_path"), path.alias("path"))).cast(entry))

    nothing = F.lit(None).cast("string")

    def step(acc: Column, f: Column) -> Column:
        name = F.regexp_extract(f, r"^[^\t]*\t[^\t]*\t([\s\S]*)$", 1)
        started = F.struct(f.alias("head"), nothing.alias("old"), F.lit(True).alias("rename"), acc["out"].alias("out"))
        whole = F.struct(F.lit("").alias("head"), nothing.alias("old"), F.lit(False).alias("rename"), add(acc, f, nothing, name).alias("out"))
        first = F.struct(acc["head"].alias("head"), f.alias("old"), F.lit(True).alias("rename"), acc["out"].alias("out"))
        second = F.struct(F.lit("").alias("head"), nothing.alias("old"), F.lit(False).alias("rename"), add(acc, acc["head"], acc["old"], f).alias("out"))
        return F.when(acc["rename"] & acc["old"].isNull(), first).when(acc["rename"], second).when(name == "", started).otherwise(whole)

    rows = df.select(*keys, F.explode(F.aggregate(fields, state, step, lambda acc: acc["out"])).alias("e"))
    part = lambda i: F.split_part(F.col("e.head"), F.lit("\t"), F.lit(i))
    binary = (part(1) == "-") | (part(2) == "-")
    number = lambda i: F.when(binary, F.lit(0)).otherwise(part(i).try_cast("long")).cast("long")
    return rows.select(*keys, F.col("e.path").alias("path"), F.col("e.old_path").alias("old_path"), number(1).alias("added"), number(2).alias("deleted"), binary.alias("binary"))


def modified_estimate(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """(keys, modified): in each hunk, the smaller of deleted and added lines of each block of replaced lines.

    A block ends at a hunk's head, a file's head or a line of context, not at the note about a missing line end.  A fold over the
    lines of each patch, which stay in their row; patches of equal keys are added up.
    """
    state = F.struct(F.lit(False).alias("in_hunk"), *[F.lit(0).cast("long").alias(c) for c in ("plus", "minus", "total")])

    def step(acc: Column, line: Column) -> Column:
        hunk, file = F.startswith(line, F.lit("@@ ")), F.startswith(line, F.lit("diff --git "))
        inside = acc["in_hunk"] & ~hunk & ~file
        plus, minus = inside & F.startswith(line, F.lit("+")), inside & F.startswith(line, F.lit("-"))
        kept = F.struct(acc["in_hunk"].alias("in_hunk"), (acc["plus"] + plus.cast("long")).alias("plus"), (acc["minus"] + minus.cast("long")).alias("minus"), acc["total"].alias("total"))
        ended = F.struct((hunk | inside).alias("in_hunk"), F.lit(0).cast("long").alias("plus"), F.lit(0).cast("long").alias("minus"), (acc["total"] + F.least(acc["plus"], acc["minus"])).alias("total"))
        return F.when(plus | minus | F.startswith(line, F.lit("\\ No newline")), kept).otherwise(ended)

    estimate = F.aggregate(F.split(patch, "\n", -1), state, step, lambda acc: acc["total"] + F.least(acc["plus"], acc["minus"]))
    return patches.where(F.col(patch).isNotNull()).select(*keys, estimate.alias("_m")).groupBy(*keys).agg(F.sum("_m").alias("modified"))


def export_rows(projects: DataFrame, files: DataFrame, totals: DataFrame) -> DataFrame:
    """File rows, a status row for each project without files, and a row of totals."""
    names = ["project", "status", "commits", "changed_files", "binary_files", "path", "added", "deleted", "modified", "net", "binary", "record_type"]
    per = projects.select(F.col("project_id").alias("project"), "status", "commits", "changed_files", "binary_files")
    f = files.select(F.col("project_id").alias("project"), "path", "added", "deleted", "modified", (F.col("added") - F.col("deleted")).alias("net"), "binary")
    rows = per.join(f, "project", "left").withColumn("record_type", F.when(F.col("path").isNull(), "ProjectStatus").otherwise("File"))
    said = F.format_string("%d projects; %d incomplete/unavailable", F.col("projects"), F.col("incomplete"))
    last = totals.select(
        F.lit("All projects").alias("project"), said.alias("status"), "commits", "changed_files", "binary_files", F.lit("").alias("path"),
        "added", "deleted", "modified", "net", F.lit(None).cast("boolean").alias("binary"), F.lit("Totals").alias("record_type"),
    )
    return rows.select(*names).unionByName(last.select(*names))

"""Which paths count: language and scope, ignore rules, size, nested repositories."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import scalars as S

SCOPES = {
    "SourceOnly": [dims.SOURCE],
    "SourceAndConfiguration": [dims.SOURCE, dims.CONFIG],
    "AllText": [dims.SOURCE, dims.CONFIG, dims.TEXT],
}


def classify(df: DataFrame, scope: str = "SourceOnly", path_col: str = "path") -> DataFrame:
    """``df`` with language and category, only paths that count in the scope."""
    return classified(df, scope, path_col, "_counts").where("_counts").drop("_counts")


def classified(df: DataFrame, scope: str, path_col: str, flag: str) -> DataFrame:
    """``df`` with language, category and the column ``flag``: whether the path counts in the scope.

    Extension or whole file name, letters in either case, first language of the registry; under AllText a file of no known
    language is plain text.
    """
    keys = F.broadcast(dims.languages(df.sparkSession))  # about a hundred rows
    name = F.lower(S.file_name(F.col(path_col)))
    ext = F.lower(S.extension(F.col(path_col)))
    by = lambda is_name, tag: keys.where(F.col("is_name") == is_name).groupBy(F.col("key").alias(f"_{tag}")).agg(
        F.min(F.struct("ord", "language", "category")).alias(f"_{tag}_hit")
    )
    found = (
        df.withColumns({"_e": ext, "_n": name})
        .join(F.broadcast(by(False, "ext")), F.col("_e") == F.col("_ext"), "left")
        .join(F.broadcast(by(True, "name")), F.col("_n") == F.col("_name"), "left")
    )
    hit = F.least("_ext_hit", "_name_hit")
    found = found.withColumn("language", F.coalesce(hit["language"], F.lit("Plain Text"))).withColumn(
        "category", F.coalesce(hit["category"], F.lit(dims.TEXT))
    )
    known = hit.isNotNull()
    keep = (F.lit(scope == "AllText") | known) & F.col("category").isin(SCOPES[scope])
    return found.select(*df.columns, "language", "category", F.coalesce(keep, F.lit(False)).alias(flag))


def glob_regex(glob: str) -> str:
    """``*`` and ``?`` stay within a name, ``**`` crosses names; everything else is literal."""
    out, i = [], 0
    while i < len(glob):
        stars = len(glob[i:]) - len(glob[i:].lstrip("*"))
        if stars > 1:
            i += stars
            folder = glob[i : i + 1] == "/"
            out.append("(?:.*/)?" if folder else ".*")
            i += folder
            continue
        c = glob[i]
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        i += 1
    return "".join(out)


def parse_rules(lines: list[str], base: str = "") -> list[tuple[str, bool, bool]]:
    """(regex, negated, folders only) of the patterns of one ignore file that stands in the folder ``base``.

    A pattern without a slash in a nested file takes the names at least one folder below ``base``.
    """
    rules = []
    for line in map(str.strip, lines):
        negated = line.startswith("!")
        body = line[negated:]
        if not line or line.startswith("#"):
            continue
        body = body[1:] if body[:2] in ("\\#", "\\!") else body
        only_folders, body = body.endswith("/"), body.rstrip("/").replace("\\", "/")
        if not body:
            continue
        fixed = "/" in body
        here = re.escape(base.strip("/")) + "/" if base.strip("/") else ""
        tail = ("(?:/.*)?" if only_folders else "") + "$"
        head = f"^{here}" if fixed else f"^(?:{here}.*/)?"
        rules.append((f"(?i){head}{glob_regex(body.lstrip('/'))}{tail}", negated, only_folders))
    return rules


RULE = "ord long, project_id string, base string, regex string, negated boolean, folders boolean"
OWN = 1 << 62  # a project's own patterns come last


def rules_frame(spark: SparkSession, defaults: list[str], files: list[tuple[str, str, list[str]]] = (), own: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """Rules in order: defaults (no project), ignore files from the root down (project, folder, lines), a project's own patterns."""
    rows = [(i, None, "", *r) for i, r in enumerate(parse_rules(list(defaults)))]
    for project, base, lines in files:
        rows += file_rules(project, base, lines)
    for project, lines in own:
        rows += [(OWN + i, project, "", *r) for i, r in enumerate(parse_rules(lines))]
    return spark.createDataFrame(rows, RULE)


def file_rules(project: str, base: str, lines: list[str]) -> list[tuple]:
    """The rules of one ignore file; deeper files come later, so they win."""
    depth = base.count("/") + bool(base)
    return [((depth + 1 << 32) + i, project, base, *r) for i, r in enumerate(parse_rules(lines, base))]


def rules_of(ignore_files: DataFrame) -> DataFrame:
    """Rules of ignore files (project_id, path, text), parsed where they are read."""

    def parse(frames):
        for frame in frames:
            rows = [r for project, path, text in zip(frame["project_id"], frame["path"], frame["text"]) for r in file_rules(project, path.rpartition("/")[0], text.splitlines())]
            yield pd.DataFrame(rows, columns=["ord", "project_id", "base", "regex", "negated", "folders"])

    return ignore_files.select("project_id", "path", "text").where("text is not null").mapInPandas(parse, RULE)


def ignored(paths: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``ignored``: the last rule that matches decides; ``paths``: keys, project_id, path, is_dir.

    Rules without a project are the caller's own list and become one expression.  The others meet, by an equi-join on the
    project and the folder of their file, the paths below that folder; each path is spelled out as its ancestors.
    """
    mark = F.struct("ord", "negated")
    general = rules.where("project_id is null").orderBy("ord").collect()  # the configured defaults
    fits = lambda r: F.regexp_like(F.col("path"), F.lit(r.regex)) & (F.col("is_dir") | F.contains(F.col("path"), F.lit("/")) if r.folders else F.lit(True))
    default = F.coalesce(
        *[F.when(fits(r), F.struct(F.lit(r.ord).alias("ord"), F.lit(r.negated).alias("negated"))) for r in reversed(general)],
        F.lit(None).cast("struct<ord:bigint,negated:boolean>"),
    )
    folders = F.concat(F.array(F.lit("")), ancestors(F.col("path")), F.when(F.col("is_dir"), F.array(F.col("path"))).otherwise(F.array().cast("array<string>")))
    spelled = paths.select(*keys, *[c for c in ("project_id", "path", "is_dir") if c not in keys], F.explode(folders).alias("base"))
    own = rules.where("project_id is not null")
    allowed = ~F.col("folders") | F.col("is_dir") | F.contains(F.col("path"), F.lit("/"))
    hits = spelled.join(own, ["project_id", "base"]).where(allowed & F.regexp_like(F.col("path"), F.col("regex")))
    last = hits.groupBy(*keys).agg(F.max(mark).alias("hit"))
    rows = paths.select(*keys, default.alias("default")).join(last, keys, "left")
    return rows.select(*keys, F.coalesce(~F.greatest("default", "hit")["negated"], F.lit(False)).alias("ignored"))


def ancestors(path: Column) -> Column:
    """The folders above a path, nearest the root first."""
    parts = F.split(path, "/", -1)
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def scannable(entries: DataFrame, rules: DataFrame, max_bytes: int = dims.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files that a scan reads, and warnings (project_id, path, warning).

    ``entries``: project_id, path (relative), is_dir, size.  Ignored folders and nested repositories (a folder below the root
    with a ``.git`` entry) are cut off with everything in them, so a negated rule revives nothing inside.
    """
    keys = ["project_id", "path", "is_dir"]
    marked = entries.join(ignored(entries, rules, keys), keys)
    git = entries.where(F.regexp_like("path", F.lit(r"/\.git$"))).select("project_id", F.regexp_replace("path", r"/\.git$", "").alias("cut"))
    nested = git.distinct().withColumn("nested", F.lit(True))
    shut = marked.where("is_dir and ignored").select("project_id", F.col("path").alias("cut"), F.lit(False).alias("nested"))
    cuts = nested.unionByName(shut).groupBy(F.col("project_id").alias("_p"), "cut").agg(F.max("nested").alias("nested"))
    # A path is below a cut folder if one of its ancestors is one: an equi-join over ancestors.
    above = marked.select(*keys, F.explode(ancestors(F.col("path"))).alias("cut"))
    below = above.join(cuts.select(F.col("_p").alias("project_id"), "cut"), ["project_id", "cut"]).select(*keys).distinct()
    live = marked.join(below, keys, "left_anti").where("not ignored")
    files = live.where("not is_dir")
    large = files.where(F.col("size") > max_bytes).select("project_id", "path", F.lit("larger than the size limit").alias("warning"))
    repos = live.where("is_dir").join(nested.withColumnRenamed("cut", "path"), ["project_id", "path"], "left_semi")
    warnings = large.unionByName(repos.select("project_id", "path", F.lit("nested repository skipped").alias("warning")))
    in_repo = files.where(F.col("size") <= max_bytes)
    return in_repo.drop("ignored"), warnings.orderBy("project_id", "path")


def below_any(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Paths with an ancestor among ``folders`` (path)."""
    up = paths.withColumn("_up", F.explode(ancestors(F.col("path"))))
    return up.join(folders.select(F.col("path").alias("_up")).distinct(), "_up", "left_semi").drop("_up").distinct()

"""Where each agent keeps its usage, how to tell that it is there, and how to load it."""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import agents
from . import files as raw
from . import record_cache, tree


MOST_BYTES = (1 << 31) - 1
ENTRY_BITS = 32


@dataclass
class Home:
    """The folders that agents write below."""

    home: str
    app_data: str
    local_app_data: str

    @classmethod
    def of(cls, home: str) -> Home:
        return cls(home, os.path.join(home, "AppData", "Roaming"), os.path.join(home, "AppData", "Local"))


# The folder or database of each agent, below the home (h), application data (a) or local data (l) folder.
PLACES = {
    "claude": ["h/.claude/projects"],
    "codex": ["h/.codex/sessions", "h/.codex/archived_sessions"],
    "antigravity-ide": ["h/.gemini/antigravity-ide/conversations"],
    "antigravity": ["h/.gemini/antigravity/conversations"],
    "agy": ["h/.gemini/antigravity-cli/conversations"],
    "zcode": ["h/.zcode/cli/db/db.sqlite"],
    "opencode": ["h/.local/share/opencode/opencode.db"],
    "kilo": ["h/.local/share/kilo/kilo.db"],
    "cline": ["h/.cline/data/sessions"],
    "copilot": ["a/Code/User/workspaceStorage"],
    "hermes": ["l/hermes/state.db"],
    "lmstudio": ["h/.lmstudio/conversations"],
}
HERMES = ["started_at", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "actual_cost_usd", "estimated_cost_usd", "api_call_count"]
ZCODE = ["started_at", "input_tokens", "output_tokens", "reasoning_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]


def places(agent: str, where: Home) -> list[str]:
    base = {"h": where.home, "a": where.app_data, "l": where.local_app_data}
    return [os.path.join(base[p[0]], p[2:]) for p in PLACES[agent]]


def detect(where: Home) -> dict[str, bool]:
    """Agents in order, and whether anything of theirs is there."""
    return {agent: any(map(os.path.exists, places(agent, where))) for agent in PLACES}


def _tree(spark: SparkSession, folders: list[str], names: str) -> DataFrame:
    """(project_id, path, size, file_ord, content) of the files below the folders, in order of folder and path.

    Names are listed and put in order without contents, which are read where the ordered names have been dealt.
    """
    roots = {f"{i:04d}": f for i, f in enumerate(folders)}
    listed = raw.source_tree(spark, roots, max_bytes=-1, names=names).where("not is_dir").select("project_id", "path", "size")
    return tree.with_contents(raw.in_order(listed), roots, MOST_BYTES)


def _documents(df: DataFrame, name: str) -> DataFrame:
    """(dir, name, ord, content) of files of ``_tree``; ord is the file's place and leaves ENTRY_BITS for its own entries."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = df.where(F.regexp_like("path", F.lit(name)))
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return rows.select(folder.alias("dir"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.shiftleft("file_ord", ENTRY_BITS).alias("ord"), text.alias("content"))


def transcripts(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Assistant records of all transcripts below the folders, in order of path and line."""
    return agents.transcript_records(raw.numbered_lines(_tree(spark, folders, r"\.jsonl$"), r"\.jsonl$"))


def kept_transcripts(spark: SparkSession, folders: list[str], cache: str, rescan: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """As ``transcripts``, unchanged files from the cache; and how many files were read and reused."""
    return record_cache.load(spark, folders, r"\.jsonl$", agents.transcript_records, os.path.join(cache, "claude"), rescan)


def kept_codex(spark: SparkSession, where: Home, cache: str, rescan: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """The records of rollouts, of known files only what was appended; and how many files were read and reused."""
    return record_cache.load(spark, places("codex", where), r"^rollout-.*\.jsonl$", agents.codex_records, os.path.join(cache, "codex"), rescan, agents.codex_carry)


def _codex(spark: SparkSession, where: Home) -> DataFrame:
    lines = raw.numbered_lines(_tree(spark, places("codex", where), r"^rollout-.*\.jsonl$"), r"\.jsonl$")
    return agents.codex_records(lines.withColumn("path", F.concat("project_id", F.lit("/"), "path")))  # both folders may hold a name


def _cline(spark: SparkSession, where: Home, files: DataFrame | None = None) -> DataFrame:
    files = _tree(spark, places("cline", where), r"\.json$") if files is None else files
    own = F.regexp_extract("path", r"^([^/]+)/", 1)
    messages = files.where(F.col("path") == F.concat(own, F.lit("/"), own, F.lit(".messages.json")))
    heads = files.where(F.col("path") == F.concat(own, F.lit("/"), own, F.lit(".json")))
    return agents.cline_records(_documents(messages, "."), _documents(heads, "."))


def _copilot(spark: SparkSession, where: Home, files: DataFrame | None = None) -> DataFrame:
    files = _tree(spark, places("copilot", where), r"\.jsonl$|^workspace\.json$") if files is None else files
    logs = _documents(files, r"^[^/]+/chatSessions/[^/]+\.jsonl$").withColumn("dir", F.regexp_replace("dir", "/chatSessions$", ""))
    return agents.copilot_records(logs, _documents(files, r"^[^/]+/workspace\.json$"))


def _lmstudio(spark: SparkSession, where: Home, files: DataFrame | None = None) -> DataFrame:
    files = _tree(spark, places("lmstudio", where), r"\.conversation\.json$") if files is None else files
    return agents.lmstudio_records(_documents(files, r"^[^/]+$"))


def _zcode(spark: SparkSession, where: Home) -> DataFrame:
    db = places("zcode", where)
    use = raw.sqlite_table(spark, db, "model_usage", "id string, session_id string, model_id string, " + ", ".join(f"{c} double" for c in ZCODE))
    return agents.zcode_records(use, raw.sqlite_table(spark, db, "session", "id string, directory string"))


def _opencode(agent: str) -> Callable[[SparkSession, Home], DataFrame]:
    def load(spark: SparkSession, where: Home) -> DataFrame:
        db = places(agent, where)
        message = raw.sqlite_table(spark, db, "message", "id string, session_id string, time_created double, data string")
        return agents.opencode_records(message, raw.sqlite_table(spark, db, "session", "id string, directory string"), agent)

    return load


def _hermes(spark: SparkSession, where: Home) -> DataFrame:
    columns = "id string, model string, cwd string, " + ", ".join(f"{c} double" for c in HERMES)
    return agents.hermes_records(raw.sqlite_table(spark, places("hermes", where), "sessions", columns))


def _antigravity(agent: str) -> Callable[[SparkSession, Home], DataFrame]:
    def load(spark: SparkSession, where: Home) -> DataFrame:
        found = sorted(p for folder in places(agent, where) for p in glob.glob(os.path.join(glob.escape(folder), "*.db")))
        t = lambda name, columns: raw.sqlite_table(spark, found, name, columns)
        return agents.antigravity_records(t("steps", "idx string, metadata binary"), t("gen_metadata", "data binary"), t("trajectory_metadata_blob", "data binary"), agent, spark.createDataFrame(list(enumerate(found)), "file_ord long, path string"))

    return load


#: How to load each agent's records.
LOADERS: dict[str, Callable[[SparkSession, Home], DataFrame]] = {
    "codex": _codex,
    "antigravity-ide": _antigravity("antigravity-ide"),
    "antigravity": _antigravity("antigravity"),
    "agy": _antigravity("agy"),
    "zcode": _zcode,
    "opencode": _opencode("opencode"),
    "kilo": _opencode("kilo"),
    "cline": _cline,
    "copilot": _copilot,
    "hermes": _hermes,
    "lmstudio": _lmstudio,
}


# ---- kept between loads ---------------------------------------------------------------------------------------------------------

#: Of agents that write whole documents: names of their files, which hold records, and the file beside each that its records depend on.
DOCUMENTS = {
    "cline": (r"\.json$", r"^([^/]+)/\1\.messages\.json$", r"^([^/]+)/\1\.json$", _cline),
    "copilot": (r"\.jsonl$|^workspace\.json$", r"^[^/]+/chatSessions/[^/]+\.jsonl$", r"^[^/]+/workspace\.json$", _copilot),
    "lmstudio": (r"\.conversation\.json$", r"^[^/]+$", None, _lmstudio),
}


def _kept_documents(spark: SparkSession, agent: str, where: Home, cache: str, rescan: bool) -> tuple[DataFrame, dict[str, int]]:
    names, holds, beside, loader = DOCUMENTS[agent]
    roots = {f"{i:04d}": f for i, f in enumerate(places(agent, where))}
    listed = raw.source_tree(spark, roots, max_bytes=-1, names=names).where("not is_dir").select("project_id", "path", "size", "modified")
    files = raw.in_order(listed).withColumn("unit", F.concat("project_id", F.lit("/"), "path")).withColumn("top", F.concat("project_id", F.lit("/"), F.regexp_extract("path", "^([^/]*)/", 1)))
    own = files.where(F.regexp_like("path", F.lit(holds)))
    heads = files.where(F.regexp_like("path", F.lit(beside)) if beside else F.lit(False))
    state = heads.select("top", F.xxhash64("size", "modified").alias("head"))
    units = own.join(state, "top", "left").select(F.col("unit").alias("path"), "file_ord", F.col("size").alias("length"), F.xxhash64("modified", F.coalesce("head", F.lit(0))).alias("modified"))

    def parse(changed: DataFrame) -> DataFrame:
        chosen = own.join(changed.select(F.col("path").alias("unit")), "unit", "left_semi")
        chosen = chosen.unionByName(heads.join(chosen.select("top").distinct(), "top", "left_semi"))
        return loader(spark, where, tree.with_contents(chosen.select("project_id", "path", "size", "file_ord"), roots, MOST_BYTES))

    return record_cache.load_documents(spark, units, parse, os.path.join(cache, agent), ENTRY_BITS, rescan)


def _kept_databases(spark: SparkSession, agent: str, where: Home, cache: str, rescan: bool) -> tuple[DataFrame, dict[str, int]]:
    """All databases of an agent are one unit, since some name what others mean; it changes with any of them or its log."""
    found = [f for place in places(agent, where) for f in (sorted(glob.glob(os.path.join(glob.escape(place), "*.db"))) if os.path.isdir(place) else [place]) if os.path.exists(f)]
    stats = [(f + end, os.stat(f + end)) for f in found for end in ("", "-wal") if os.path.exists(f + end)]
    state = hashlib.sha256(repr([(f, s.st_size, s.st_mtime_ns) for f, s in stats]).encode()).digest()
    units = spark.createDataFrame([(agent, 0, sum(s.st_size for _, s in stats), int.from_bytes(state[:8], "big", signed=True))], record_cache.UNIT)
    return record_cache.load_documents(spark, units, lambda _: LOADERS[agent](spark, where), os.path.join(cache, agent), None, rescan)


def kept(spark: SparkSession, agent: str, where: Home, cache: str, rescan: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """The records of an agent, read again only where its files or databases have changed; and how many were read and reused."""
    if agent == "claude":
        return kept_transcripts(spark, places("claude", where), cache, rescan)
    if agent == "codex":
        return kept_codex(spark, where, cache, rescan)
    return (_kept_documents if agent in DOCUMENTS else _kept_databases)(spark, agent, where, cache, rescan)

"""Patch logs: each patch is a function of the document, functions are composed, and a log is the composition of its blocks.

A function is kept in a form that a later one joins without the document:
  Const       the document is this value, whatever it was
  Steps       one after another: ``Inside`` (functions of members, by name) and ``Cuts`` (what happens to a list)
Two ``Inside`` steps in a row become one, member by member; two ``Cuts`` become one list of cuts, appended items in one
rope; after a ``Const`` everything is worked out at once, and before one everything is forgotten.  Composition is
associative, so blocks of a log are composed apart, in any grouping, as long as their order is kept.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ITEMS = 1 << 24  # a list is not made longer than this by an index
BLOCK = 4096  # lines that are composed at once


def is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def member(key) -> str:
    """The name under which an object has a key; a list has it as an index if it is a whole number's text."""
    if isinstance(key, str):
        return key
    if is_number(key):
        return str(int(key)) if math.isfinite(key) and key == int(key) and abs(key) < 1e21 else repr(key)
    return json.dumps(key)


def index(name: str) -> int | None:
    return int(name) if name.isdecimal() and name.isascii() and (name == "0" or name[0] != "0") and len(name) < 9 and int(name) < MOST_ITEMS else None


@dataclass
class Const:
    value: object

    def __call__(self, _):
        return self.value


@dataclass
class Inside:
    """Changes of members; ``indexed``: what stands there, if it is no object or list, becomes a list instead of an object."""

    indexed: bool
    members: dict[str, Const | Steps] = field(default_factory=dict)

    def __call__(self, value):
        if not isinstance(value, (dict, list)):
            value = [] if self.indexed else {}
        for name, change in self.members.items():
            if isinstance(value, dict):
                value[name] = change(value.get(name))
            elif (at := index(name)) is not None:
                value += [None] * (at + 1 - len(value))
                value[at] = change(value[at])
        return value


@dataclass
class Cuts:
    """Of a list (anything else counts as an empty one): keep the items before a place, or all, and append some; again and again."""

    cuts: list[tuple[float | None, list]]

    def __call__(self, value):
        items = value if isinstance(value, list) else []
        for place, more in self.cuts:
            if place is not None:
                begin = max(len(items) + math.trunc(place), 0) if place < 0 else min(math.trunc(place), len(items))
                gone = min(max(math.trunc(len(items) - place), 0), len(items) - begin)
                items[begin:] = more + items[begin + gone :]
            else:
                items += more
        return items


@dataclass
class Steps:
    steps: list[Inside | Cuts] = field(default_factory=list)

    def __call__(self, value):
        for step in self.steps:
            value = step(value)
        return value


Change = Const | Steps


def then(first: Change | None, second: Change) -> Change:
    """Both, one after the other; the arguments are used up."""
    if first is None or isinstance(second, Const):
        return second
    if isinstance(first, Const):
        return Const(second(first.value))
    for step in second.steps:
        last = first.steps[-1] if first.steps else None
        if isinstance(last, Inside) and isinstance(step, Inside):
            for name, change in step.members.items():
                last.members[name] = then(last.members.get(name), change)
        elif isinstance(last, Cuts) and isinstance(step, Cuts):
            for place, more in step.cuts:
                if place is None and last.cuts:
                    last.cuts[-1][1].extend(more)
                else:
                    last.cuts.append((place, more))
        else:
            first.steps.append(step)
    return first


def at(path: list, change: Change) -> Change:
    """``change`` at the end of a path: each key but the first says what its holder has to be."""
    for key in reversed(path):
        change = Steps([Inside(is_number(key), {member(key): change})])
    return change


def change_of(patch) -> Change | None:
    """The function of one patch; null where it does nothing."""
    if not isinstance(patch, dict) or not is_number(patch.get("kind")):
        return None
    kind, path, value = patch["kind"], patch.get("k"), patch.get("v")
    if kind == 0:
        return Const(value if isinstance(value, (dict, list)) else {})
    if kind not in (1, 2) or not isinstance(path, list) or not path:
        return None
    if kind == 1:  # response bodies are large and nobody reads them
        return None if path[-1] == "response" else at(path, Const(value))
    place = patch.get("i")
    return at(path, Steps([Cuts([(place if is_number(place) else None, value if isinstance(value, list) else [value])])]))


def completion_of(patch) -> tuple[str, float] | None:
    """(request, tokens) where a patch sets a request's completion tokens."""
    path = patch.get("k") if isinstance(patch, dict) and patch.get("kind") == 1 and patch.get("kind") is not True else None
    if isinstance(path, list) and len(path) == 3 and path[0] == "requests" and path[2] == "completionTokens" and is_number(path[1]) and path[1] == int(path[1]):
        tokens = patch.get("v")
        return member(path[1]), float(tokens) if is_number(tokens) and math.isfinite(tokens) else 0.0
    return None


@dataclass
class Log:
    """A part of a log: its function and the most completion tokens set for each request."""

    change: Change | None = None
    completion: dict[str, float] = field(default_factory=dict)

    def and_then(self, more: Log) -> Log:
        if more.change is not None:
            self.change = then(self.change, more.change)
        for request, tokens in more.completion.items():
            self.completion[request] = max(self.completion.get(request, 0.0), tokens)
        return self

    def document(self):
        return {} if self.change is None else self.change({})


def of_lines(lines: Iterable[str]) -> Log:
    log = Log()
    for line in lines:
        try:
            patch = json.loads(line) if line else None
        except ValueError:
            continue
        seen = completion_of(patch)
        log.and_then(Log(change_of(patch), dict([seen]) if seen else {}))
    return log


def packed(log: Log) -> str:
    def out(change: Change | None):
        if change is None:
            return None
        if isinstance(change, Const):
            return {"const": change.value}
        return [{"in": {n: out(c) for n, c in s.members.items()}, "list": s.indexed} if isinstance(s, Inside) else {"cuts": s.cuts} for s in change.steps]

    return json.dumps({"change": out(log.change), "completion": log.completion})


def unpacked(text: str) -> Log:
    def back(x) -> Change | None:
        if x is None:
            return None
        if isinstance(x, dict):
            return Const(x["const"])
        return Steps([Inside(s["list"], {n: back(c) for n, c in s["in"].items()}) if "in" in s else Cuts([(p, m) for p, m in s["cuts"]]) for s in x])

    raw = json.loads(text)
    return Log(back(raw["change"]), raw["completion"])


def documents(files: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``keys`` with ``state`` (the document as JSON) and ``completion`` of each log of ``files`` (keys, content).

    Blocks of lines are composed where Spark deals them; a log's task then composes its blocks.
    """

    @F.pandas_udf("string")
    def composed(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda lines: packed(of_lines(lines)))

    @F.pandas_udf("state string, completion map<string, double>")
    def joined(parts: pd.Series) -> pd.DataFrame:
        logs = []
        for some in parts:
            log = Log()
            for text in some:
                log.and_then(unpacked(text))
            logs.append(log)
        return pd.DataFrame({"state": [json.dumps(log.document()) for log in logs], "completion": [log.completion for log in logs]})

    lines = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    rows = files.select(*keys, lines.alias("_lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / block).cast("int"))
    rows = rows.select(*keys, F.posexplode(F.transform(starts, lambda k: F.slice("_lines", k * block + 1, F.lit(block)))).alias("_block", "_some"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = rows.repartition(tasks, *keys, "_block").select(*keys, "_block", composed("_some").alias("_part"))
    logs = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_part"))).alias("_parts"))
    return logs.select(*keys, joined(F.transform("_parts", lambda p: p["_part"])).alias("_r")).select(*keys, "_r.state", "_r.completion")

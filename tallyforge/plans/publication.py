"""Several tables that appear together or not at all.

A folder that driver and executors share holds ``state.json``, which names the folder of each table in force, and the folders.  A
draft writes its tables beside them; its commit swaps the document in one step.  A run that dies before that leaves
the state before it, and what it wrote is cleared by the next commit.
"""

from __future__ import annotations

import fcntl
import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources import sinks


class Conflict(RuntimeError):
    """Another run has published since this one began."""


class Publication:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    def _document(self) -> str:
        return os.path.join(self.folder, "state.json")

    def state(self) -> dict:
        return sinks.read_document(self._document(), {"version": None, "tables": {}})

    def read(self, name: str) -> DataFrame | None:
        """A table in force, null before its first publication."""
        at = self.state()["tables"].get(name)
        return self.spark.read.parquet(os.path.join(self.folder, at)) if at else None

    @contextmanager
    def draft(self) -> Iterator[Draft]:
        """Tables written in the block are published at its end; if it fails, nothing of it stays."""
        draft = Draft(self)
        try:
            yield draft
            draft.commit()
        except BaseException:
            draft.drop()
            raise


class Draft:
    def __init__(self, publication: Publication):
        self.publication, self.version, self.base = publication, uuid.uuid4().hex, publication.state()
        self.tables: dict[str, str] = {}

    def _at(self, name: str) -> str:
        return os.path.join(self.publication.folder, f"v-{self.version}", name)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """The table as it will be published, read back: what made it is not run again."""
        df.write.parquet(self._at(name))
        self.tables[name] = os.path.join(f"v-{self.version}", name)
        return df.sparkSession.read.schema(df.schema).parquet(self._at(name))

    def old(self, name: str) -> DataFrame | None:
        at = self.base["tables"].get(name)
        return self.publication.spark.read.parquet(os.path.join(self.publication.folder, at)) if at else None

    def commit(self) -> None:
        folder = self.publication.folder
        with open(os.path.join(folder, ".lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if self.publication.state()["version"] != self.base["version"]:
                raise Conflict(folder)
            tables = self.base["tables"] | self.tables
            sinks.write_document({"version": self.version, "tables": tables}, self.publication._document())
            used = {at.split(os.sep)[0] for at in tables.values()}
            for name in os.listdir(folder):  # versions that no table is in, and drafts of runs that died
                if name.startswith("v-") and name not in used:
                    shutil.rmtree(os.path.join(folder, name), ignore_errors=True)

    def drop(self) -> None:
        if self.publication.state()["version"] != self.version:
            shutil.rmtree(os.path.join(self.publication.folder, f"v-{self.version}"), ignore_errors=True)

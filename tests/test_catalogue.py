"""Every query against its SQL on the smallest tables."""

import glob
import importlib
import os
import sys

import duckdb
import pytest

from tallyforge.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(f"{float(v):.9g}")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.sql(catalogue.ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry_without_the_training_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tallyforge.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tallyforge.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert catalogue.entry(spark, SF).count() > 0

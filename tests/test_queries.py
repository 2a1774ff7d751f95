"""Every registered query of the library's own operators against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest
from skyloom.plans.registry import COVERS, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(frame):
    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_query_names_what_it_covers():
    assert set(COVERS) == set(QUERIES) and all(COVERS.values())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 144
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry_without_the_text_package(monkeypatch):
    """A library that only the text queries need may be missing; the others stay."""
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("skyloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "skyloom.llm", None)
    entry = importlib.import_module("__spark_entry__")
    with pytest.warns(UserWarning, match="text queries"):
        assert set(entry.queries()) == set(QUERIES)

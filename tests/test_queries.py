"""Every named query against its SQL on the smallest tables, and the entry points."""

import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def db():
    """A database for each query, so that a failure stays with its own."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    yield con
    con.close()


def rows(frame: pd.DataFrame) -> list:
    plain = lambda v: None if v is None or v is pd.NA or v != v else (float(v) if isinstance(v, float) else v.item() if hasattr(v, "item") else v)
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    names, got = rows(entry.queries()[name](spark, FOLDER).toPandas())
    want_names, want = rows(db.execute(entry.oracle_sql()[name]).fetch_df())
    assert names == want_names
    norm = lambda own: [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in own]
    assert sorted(norm(got), key=repr) == sorted(norm(want), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["round_id", "t_start", "t_end", "score", "state_id", "n_states", "exact"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_package(monkeypatch):
    """The library's own queries are there when that subpackage and its pipeline aren't."""
    for name in ("tacgrid.llm", "tacgrid.llm.registry", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # importing it raises ImportError, as a missing dependency does
    assert "search_full" in entry.queries() and not any(k.startswith("op") or k == "pipeline" for k in entry.queries())
    assert "search_full" not in entry.oracle_sql() or not any(k.startswith("op") for k in entry.oracle_sql())

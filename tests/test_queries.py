"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(frame):
    return sorted("\x1f".join(map(str, r)) for r in frame[sorted(frame.columns)].astype(str).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, data, duck, name):
    ours = entry.queries()[name](spark, data).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_ranked_hits(spark):
    out = entry.entry(spark).toPandas()
    assert set(out.columns) == {"item_id", "doc_id", "score", "rank"} and len(out) > 0 and out["rank"].max() <= 6

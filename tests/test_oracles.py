"""Every registered query of the engine that SQL can express, against DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tessella.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert [str(got[c].dtype) for c in cols] == [str(want[c].dtype) for c in cols]
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(map(tuple, want[cols].to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_others_have_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).head(1)

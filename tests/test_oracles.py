"""Every registered query with SQL gives DuckDB's rows; every other one runs."""

import math
from pathlib import Path

import duckdb
import pytest

import mnemospark.plans  # noqa: F401
from mnemospark.registry import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    mine = sorted((repr([plain(r[c]) for c in order]) for r in df.collect()))
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == order
    at = [columns.index(c) for c in order]
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150

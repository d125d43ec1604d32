"""Every query with SQL agrees with DuckDB on the same tables."""

import math

import duckdb
import pytest

from pointloom.jobs import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


def rows(names, found, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got = rows(df.columns, df.collect(), order)
    assert got == rows(want.columns, want.fetchall(), order)
    assert got or name == "large_groups"  # no group is that large in the smallest tables


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())


def test_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr

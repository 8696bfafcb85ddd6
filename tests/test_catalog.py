"""Every catalogued query with SQL gives the SQL's rows."""

from __future__ import annotations

import duckdb
import pytest

from tessella.plans import catalog, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(smallest):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{smallest}/{t}.parquet'")
    return c


def plain(x):
    return ("f", round(x, 6) + 0.0) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_matches_sql(spark, duck, smallest, name):
    df = catalog.CATALOG[name](spark, smallest)
    cols = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({oracle.SQL[name]}) z").fetchall()
    assert got == sorted(repr([plain(v) for v in r]) for r in want)


@pytest.mark.parametrize("name", sorted(set(catalog.CATALOG) - set(oracle.SQL)))
def test_rows_without_sql(spark, smallest, name):
    assert catalog.CATALOG[name](spark, smallest).count() > 0


def test_headline_covers_the_engine():
    import bench

    assert len(bench.HEADLINE) == 16 and set(bench.HEADLINE) <= set(__import__("__spark_entry__").queries())

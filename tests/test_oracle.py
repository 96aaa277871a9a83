"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from pointloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame):
    def plain(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return "null"
        return f"{float(x):.10g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, small, duck, name):
    found, wanted = catalog.QUERIES[name](spark, small).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) == len(wanted)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).take(1)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).take(1)
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from eventsort import catalogue, catalogue_files  # noqa: F401  registers queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    objects = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(str(tuple(map(plain, r))) for r in objects.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, expected = catalogue.QUERIES[name](spark, DATA).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(expected, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query with SQL gives the rows that DuckDB gives for it, on whole tables."""

from collections import Counter

import duckdb
import pytest
from conftest import SF

from siftspark import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    known = frame[columns].astype(object)
    return Counter(map(tuple, known.where(frame[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(theirs.columns)
    assert columns == sorted(ours.columns)
    assert rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0

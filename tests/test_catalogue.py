"""Every registered trace and graph query against its SQL, row by row, on the smallest tables."""

import datetime
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from strandline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    columns = sorted(found.columns)
    wanted = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    place = [wanted.columns.index(c) for c in columns]
    got = Counter(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert got == Counter(tuple(plain(r[i]) for i in place) for r in wanted.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

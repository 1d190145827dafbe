"""Every query against its SQL, over the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from tessera.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in os.listdir(DIR):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DIR}/{file}'")
    return connection


def _rows(table):
    def plain(v):
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 9)
        return str(v)[:19] if isinstance(v, (datetime.date, datetime.datetime)) else v

    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, row)) for row in zip(*(table.column(n).to_pylist() for n in names))), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sql, name):
    names, found = _rows(catalog.QUERIES[name](spark, DIR).toArrow())
    expected_names, expected = _rows(sql.execute(catalog.ORACLE_SQL[name]).to_arrow_table())
    assert names == expected_names
    assert found == expected


def test_entry_module():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sheaf.checks import code_checks, file_checks, page_checks, token_checks, tree_checks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
ROWS_ONLY = {"read_tree"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


# The training-data operators have tests of their own.
NAMES = [name for module in (file_checks, token_checks, page_checks, code_checks, tree_checks) for name in module.QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name in ROWS_ONLY:
        assert rows
        return
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert rows_of(df.columns, rows) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 4

"""Every query that has SQL gives the same rows as DuckDB."""

import __spark_entry__ as entry
import pytest

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = sorted(n for n in QUERIES if not n.startswith("op") and n != "pipeline")


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_same_rows_as_sql(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = oracle.execute(SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(SQL) <= set(QUERIES)

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_points


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["doc_id", "masked_text", "n_findings", "secret_lines"] and df.count() == 200


def test_names():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90


SKIP_PLANTED = [n for n in entry_points.queries() if not n.startswith("planted_") or n == "planted_ssh"]


@pytest.mark.parametrize("name", SKIP_PLANTED)
def test_query_against_sql(spark, small, name):
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no SQL for this query")
    connection = duckdb.connect()
    for file in os.listdir(small):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    df = entry_points.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = connection.sql(sql)
    assert sorted(want.columns) == columns

    def rows(source):
        return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in source], key=repr)

    assert rows(df.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())

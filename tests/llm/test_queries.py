"""The registered queries against their SQL, over the smallest folder, and the shape of those that have none."""

import duckdb
import pandas as pd
import pytest

from encore.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    expected, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, FOLDER).toPandas()
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    ordered = [x[columns].sort_values(columns).reset_index(drop=True) for x in (expected, got)]
    pd.testing.assert_frame_equal(*ordered, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_whole_tables(spark, name):
    found = QUERIES[name](spark, FOLDER)
    ids = [r[0] for r in found.select("doc_id").distinct().collect()]
    assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())

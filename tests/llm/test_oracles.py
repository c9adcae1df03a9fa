import glob
import os

import duckdb
import pytest

from inkstone.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = queries()[name](spark, folder)
    result = connection.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=repr) == sorted(result.fetchall(), key=repr)

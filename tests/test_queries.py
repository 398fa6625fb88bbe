"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from folioscope import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return Counter(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())


def test_entry_imports_without_training_data():
    import __spark_entry__ as entry

    assert set(catalog.ORACLES) <= set(entry.oracle_sql()) and set(catalog.QUERIES) <= set(entry.queries())

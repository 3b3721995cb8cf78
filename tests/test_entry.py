import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.queries import FILES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted({**QUERIES, **FILES}))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    tidy = lambda rows: sorted(tuple(str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in rows)
    assert tidy(got.select(*columns).collect()) == tidy(found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

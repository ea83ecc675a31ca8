"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from orbweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def said(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(said, v)) + "]"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(map(said, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(said, r)) for r in df.select(*names).collect()) == expected


def test_names():
    assert set(catalog.oracle_sql()) <= set(entry.queries())

"""Every registered query with SQL returns the rows that DuckDB returns."""

import duckdb
import pytest

from peakweave.plans.queries import QUERIES

SIZES = ("sf0.01",)  # keys that are unique in the smallest tables repeat here
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module", params=SIZES)
def tables(request):
    con, path = duckdb.connect(), f"/root/testdata/{request.param}"
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return path, con


def rows(found):
    return sorted([tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in found], key=repr)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query(spark, tables, name):
    path, duck = tables
    df = QUERIES[name].run(spark, path)
    columns = sorted(df.columns)
    want = duck.sql(QUERIES[name].sql)
    assert sorted(want.columns) == columns
    got = rows(map(tuple, df.select(*columns).collect()))
    assert got and got == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())

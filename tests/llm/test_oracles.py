"""The SQL of the training-data operators, which test_oracle.py leaves out, against their rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from peakweave.plans.queries import QUERIES

SF = Path("/root/testdata/sf0.001")


def rows(found):
    return sorted([tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(QUERIES)))
def test_query(spark, name):
    con = duckdb.connect()
    for table in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    df = entry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert rows(map(tuple, df.select(*columns).collect())) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())

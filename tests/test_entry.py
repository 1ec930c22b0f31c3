"""The driver's contract, and queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = ("events", "part", "nation")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_against_sql(spark, name):
    frame = plans.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())
    if name not in plans.oracles():
        assert rows
        return
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({plans.oracles()[name]}) q").fetchall()
    assert rows == sorted(map(str, want))

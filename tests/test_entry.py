import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 150


@pytest.mark.parametrize("name", [n for n in ORACLE if n.startswith("er_")])
def test_query_equals_its_oracle(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = db.sql(ORACLE[name])
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [list(want.columns).index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())

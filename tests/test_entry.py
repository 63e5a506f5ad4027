"""The contract file: it imports without a session, names agree, and queries equal their SQL."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, cwd=os.path.dirname(entry.__file__))


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in entry.registry.ORACLES if not n.startswith(("stream_", "sql_", "delta_"))))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from marlstone.session import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    plain = lambda row: str([row[c] for c in sorted(names)])
    left = sorted(plain(r.asDict()) for r in df.collect())
    right = sorted(plain(dict(zip(names, r))) for r in got.fetchall())
    assert left == right

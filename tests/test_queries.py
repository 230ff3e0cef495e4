"""Every query with SQL against DuckDB on the smallest tables, and every other one for a stable schema."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}" if v != int(v) else str(int(v))
    return str(v.tolist()) if hasattr(v, "tolist") else str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def names(with_sql):
    sql = entry.oracle_sql()
    # the optional subpackage has tests of its own
    return [n for n, f in entry.queries().items() if (n in sql) == with_sql and ".llm" not in f.__module__]


@pytest.mark.parametrize("name", names(True))
def test_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", names(False))
def test_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.columns == entry.queries()[name](spark, FOLDER).columns
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_optional_package_is_not_needed():
    import subprocess
    import sys

    code = "import sys; sys.modules['derlem.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p7_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(entry.__file__))).returncode == 0

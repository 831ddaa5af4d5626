"""The driver's queries against their SQL, on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SPATIAL = __import__("terrafold.plans.queries", fromlist=["QUERIES"]).QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]
    import pandas as pd

    text = lambda x: "null" if pd.isna(x) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(text(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in "customer orders documents pages embeddings".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SPATIAL))
def test_same_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["priority", "pairs", "area", "xmin", "ymin", "xmax", "ymax"]


def test_a_missing_library_leaves_the_spatial_queries():
    code = "import sys; sys.modules['zstandard'] = None\nimport __spark_entry__ as e\nassert set(e.queries()) == set(e.SPATIAL_QUERIES) and set(e.oracle_sql()) == set(e.SPATIAL_ORACLES), set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))

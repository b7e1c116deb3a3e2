import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    """Compare a query with its SQL on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SMALL}/{name}'")

    def same(got, sql):
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        plain = lambda x: None if x is None or x != x else (int(x) if isinstance(x, float) and x == int(x) else x)
        rows = lambda f: sorted(map(str, ([plain(v) for v in r] for r in f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist())))
        assert rows(got) == rows(want)

    return same

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the tables of a folder as views."""
    import duckdb

    def connect(folder):
        c = duckdb.connect()
        for p in glob.glob(f"{folder}/*.parquet"):
            c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
        return c

    return connect


def rows(frame):
    """A frame's rows with columns by name, floats rounded, in order."""
    import pandas as pd

    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 4) + 0.0 if isinstance(x, float) else float(x) if isinstance(x, int) and not isinstance(x, bool) else x

    return sorted(([*map(plain, r)] for r in frame.itertuples(index=False)), key=repr), list(frame.columns)


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        assert rows(a) == rows(b)

    return check

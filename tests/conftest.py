"""One Spark session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Runs a query and its DuckDB form over one folder and compares all rows."""
    import duckdb

    def compare(query, sql: str, folder: str) -> int:
        con = duckdb.connect()
        for path in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        want = con.execute(sql).df()
        got = query(spark, folder).toPandas()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        cell = lambda x: "" if x is None or x is pd.NA or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
        rows = lambda d: sorted(tuple(map(cell, r)) for r in d[columns].astype(object).itertuples(index=False))
        assert rows(want) == rows(got)
        return len(got)

    return compare

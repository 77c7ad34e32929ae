"""Shared session and helpers of the tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def same_rows():
    """Compares a Spark result with DuckDB SQL, order-free, doubles at 6 decimals."""
    import numpy as np
    import pandas as pd

    def text(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)):
            return repr(round(float(v), 6))
        return str(v)

    def rows(frame):
        cols = sorted(frame.columns)
        return cols, sorted(tuple(text(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))

    def check(frame, duck, sql):
        assert rows(frame.toPandas()) == rows(duck.sql(sql).df())

    return check

"""A session for all tests, and the shared tables in DuckDB."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf():
    return SF


def plain(x):
    """A value that compares the same from either engine."""
    if x is None or x is pd.NA or x != x:
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x


def rows(result) -> tuple[list[str], list[tuple]]:
    """Columns and sorted rows of a pandas frame."""
    result = result.reindex(sorted(result.columns), axis=1).astype(object)
    return list(result.columns), sorted((tuple(plain(x) for x in r) for r in result.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def same():
    def check(got, want):
        (gc, gr), (wc, wr) = rows(got), rows(want)
        assert gc == wc
        assert len(gr) == len(wr)
        for a, b in zip(gr, wr, strict=True):
            assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-4) for x, y in zip(a, b, strict=True)), (a, b)

    return check

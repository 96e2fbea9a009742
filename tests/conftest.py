"""One local session for all tests, and the small tables."""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidegate.session import local_session

    session = local_session("4", partitions=4, memory="4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else glob.escape(path) + '/*.parquet'}'")
    return con


def _plain(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(int(value)) if isinstance(value, bool) else str(value)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a DataFrame and a SQL text give the same rows, in any order."""

    def check(df, sql):
        got, want = df.toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        rows = lambda x: sorted(tuple(map(_plain, r)) for r in x[names].itertuples(index=False, name=None))
        assert rows(got) == rows(want)

    return check

"""Every query of the core catalogue against its oracle text in DuckDB."""

import numbers
import os

import pandas as pd
import pytest

from attestia.plans import catalogue
from attestia.session import TABLES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the generated tables are not here")


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return db


def canonical(frame):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        return str(round(float(v), 9)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    want = oracle.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_query_runs_without_an_oracle(spark):
    for name in catalogue.QUERIES.keys() - catalogue.ORACLES.keys():
        assert catalogue.QUERIES[name](spark, FOLDER).count() > 0

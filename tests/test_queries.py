"""Every registered query with an oracle agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from quern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 4) + 0.0 if isinstance(v, float) else str(v) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() == 1

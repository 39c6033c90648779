"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from poolsieve.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return [norm(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str([norm(r[c]) for c in columns]) for r in df.collect())
    assert rows
    if name in ORACLES:
        found = db.execute(ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        assert rows == sorted(str([norm(r[names.index(c)]) for c in columns]) for r in found.fetchall())

"""Every core query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from voxmill.plans.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "tolist"):
        return norm(x.tolist())
    return [norm(v) for v in x] if isinstance(x, list) else x


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    got = queries()[name](spark, DIR)
    cols = sorted(got.columns)
    rel = con.execute(oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    have = [tuple(norm(v) for v in r) for r in got.select(*cols).collect()]
    key = lambda r: [str(v) for v in r]
    assert sorted(have, key=key) == sorted(want, key=key)

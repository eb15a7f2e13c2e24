"""Every registered query that has SQL gives the SQL's rows, as sets with counts."""

import math
from collections import Counter

import duckdb
import pytest

from isobar.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else v
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_is_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(norm(v) for v in r) for r in cur.fetchall())
    got = Counter(tuple(norm(v) for v in r) for r in df.select(*names).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0

"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from gritsieve.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return ("nan" if math.isnan(v) else v + 0.0) if isinstance(v, float) else v


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    want = _sorted([tuple(_plain(r[names.index(c)]) for c in columns) for r in con.fetchall()])
    got = _sorted([tuple(_plain(r[c]) for c in columns) for r in df.collect()])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            assert x == pytest.approx(y, abs=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    rows = {r["item"]: r["value"] for r in registry.flagship(spark, SF).collect()}
    assert rows["total"] > 0 and rows["flagged"] >= rows["method:zscore"]

"""Every query that SQL can express against DuckDB; the others run and give what they should."""

import duckdb
import pytest

from lumenfew import plans
from lumenfew.plans import models

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return "null" if v is None or v != v else f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    got = plans.queries()[name](spark, sf)
    rel = con.sql(plans.oracle_sql()[name])
    names = sorted(rel.columns)
    assert sorted(got.columns) == names
    want = sorted(tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())
    assert want and sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(models.QUERIES))
def test_models_run(spark, sf, name):
    rows = plans.queries()[name](spark, sf).collect()
    assert rows and all(v is not None for r in rows[:5] for v in r)


def test_names_are_one_set():
    assert set(plans.oracle_sql()) <= set(plans.queries())

"""Every registered query of the engine against its SQL twin on the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

from opineflow.plans import anchors as _anchors  # noqa: F401
from opineflow.plans import more as _more  # noqa: F401
from opineflow.plans import queries as plans
from opineflow.plans import rules as _rules  # noqa: F401
from opineflow.plans import layouts as _layouts  # noqa: F401
from opineflow.plans import scores as _scores  # noqa: F401
from opineflow.plans import stages as _stages  # noqa: F401
from opineflow.plans import stores as _stores  # noqa: F401
from opineflow.plans import evaluate as _evaluate  # noqa: F401
from opineflow.plans import wide as _wide  # noqa: F401

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return con


def cells(rows):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else f"{x:.6g}"
        if isinstance(x, dt.datetime) and x.time() == dt.time():
            x = x.date()
        return None if x is None else str(x)

    return sorted(([one(x) for x in r] for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", list(plans.queries()))
def test_against_sql(spark, duck, name):
    got = plans.queries()[name](spark, ROOT)
    if (sql := plans.oracle_sql().get(name)) is None:
        assert got.columns
        return
    want = duck.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert cells(got.select(names).collect()) == cells([r[i] for i in at] for r in want.fetchall())


def test_entry_stands_alone():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())

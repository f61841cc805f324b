"""Every registered query with an oracle equals its DuckDB text at sf0.01
(row count, column names, order-insensitive values)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from clickscore.plans.catalog import REGISTRY
from scripts.check_oracle import rows_of
from tests.conftest import SF01

SQL = {k: e.sql for k, e in REGISTRY.items() if e.sql is not None}


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF01)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(SQL[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(scols, srows) == rows_of(dcols, drows)


def test_every_query_has_a_callable_and_runs_rows_only(spark):
    qs = REGISTRY
    assert set(qs) <= set(E.queries())
    rows_only = [k for k in qs if k not in SQL]
    # the fitted-model tables are the only entries without an oracle
    assert all(k.removeprefix("a9_export_").startswith("m") for k in rows_only), rows_only          # fitted models


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.columns) == 51           # 3 keys + 48 usage columns
    assert df.count() >= 0

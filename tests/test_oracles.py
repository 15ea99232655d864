"""Every query with SQL against an independent engine, and the shape of the others."""

from __future__ import annotations

import pytest
from conftest import SF, same_rows

from quillon.plans.oracles import ORACLES
from quillon.plans.queries import QUERIES

FAST = ["svd_reduce", "leverage_topk", "spa", "simplex_regression", "hash_ids", "mwm", "map_clusters", "spanner", "mutual_neighbours"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", FAST)
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_lists_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

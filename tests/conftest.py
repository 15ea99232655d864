from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        at = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return con


def same_rows(ours, theirs, tolerance: float = 2e-6) -> None:
    """Equal columns and rows in any order, numbers within a rounding step."""
    import pandas as pd

    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    cols = sorted(ours.columns)
    exact = [c for c in cols if not pd.api.types.is_float_dtype(theirs[c])]
    order = exact + [c for c in cols if c not in exact]
    a, b = (x[order].sort_values(order).reset_index(drop=True) for x in (ours, theirs))
    for c in order:
        if c in exact:
            assert a[c].astype(object).where(a[c].notna(), None).map(str).tolist() == b[c].astype(object).where(b[c].notna(), None).map(str).tolist(), c
        else:
            pd.testing.assert_series_equal(a[c].astype(float), b[c].astype(float), check_names=False, rtol=1e-5, atol=tolerance)

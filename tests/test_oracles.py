"""Every query of the engine's own operators against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from strata.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR).toPandas()
    if name not in ORACLES:
        assert len(found.columns) > 0
        return
    wanted = duck.execute(ORACLES[name]).fetchdf()
    pd.testing.assert_frame_equal(plain(found), plain(wanted), check_dtype=False)

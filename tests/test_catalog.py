"""Every catalogue query against its DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from stratamol.plans import catalog, extra  # noqa: F401 (extra adds its queries)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as from '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns, key=lambda c: (got[c].dtype.kind == "f", c))
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        assert all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a[c], b[c], strict=True)), c

"""Every registered reference query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sparkweave.plans import catalog, curation, lifecycle, service  # noqa: F401

DATA = "/root/testdata/sf0.001"


def rows(df, cols):
    cell = lambda x: None if pd.isna(x) else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(str([cell(x) for x in r]) for r in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for t in ("embeddings", "events", "part", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))

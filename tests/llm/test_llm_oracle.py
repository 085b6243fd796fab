"""Queries of the subpackage against their DuckDB statements."""

import duckdb
import pandas as pd
import pytest

from faultline.llm.oracle import ORACLE
from faultline.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name]).df()
    got = REGISTRY[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = [c for c in ("doc_id", "query_id", "rank", "page_id") if c in cols]
    a, b = (x[cols].sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)

"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _sorted(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def assert_same(spark_df, con, sql: str) -> int:
    left, right = _sorted(spark_df.toPandas()), _sorted(con.execute(sql).df())
    assert list(left.columns) == list(right.columns), (list(left.columns), list(right.columns))
    assert len(left) == len(right), (len(left), len(right), left.head(), right.head())
    for c in left.columns:
        kinds = left[c].dtype.kind, right[c].dtype.kind
        assert kinds[0] == kinds[1], (c, left[c].dtype, right[c].dtype)
        same = (left[c] == right[c]) | (left[c].isna() & right[c].isna())
        assert same.all(), (c, left[~same].head(), right[~same].head())
    return len(left)

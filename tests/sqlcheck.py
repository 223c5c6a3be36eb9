"""Spark against SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb


def rows_of(frame) -> list[tuple]:
    def norm(v):
        return "NULL" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)

    cols = sorted(frame.columns)
    f = frame[cols].astype(object)
    return sorted(tuple(norm(x) for x in r) for r in f.where(f.notna(), None).itertuples(index=False))


def duck(sf_dir: str):
    c = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        c.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def check(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    assert "CartesianProduct" not in plan_of(df) and "NestedLoopJoin" not in plan_of(df)
    got, want = df.toPandas(), duck(sf_dir).execute(sql).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)

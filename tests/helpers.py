"""Comparison of a Spark result with a DuckDB one."""

import math
import numbers

import pandas as pd


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "null"
    if hasattr(v, "tolist") and not isinstance(v, pd.Timestamp):
        v = v.tolist()
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v + 0.0 if v else 0.0:.9g}"
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return f"{float(v):.9g}" if not isinstance(v, int) else f"{v:.9g}" if abs(v) < 10**8 else str(v)
    if isinstance(v, pd.Timestamp) or type(v).__name__ in ("date", "datetime"):
        return str(pd.Timestamp(v))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(_cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark_df, duck_df: pd.DataFrame) -> None:
    got = spark_df.toPandas()
    assert sorted(got.columns) == sorted(duck_df.columns)
    a, b = rows(got), rows(duck_df)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, wrong[:3]

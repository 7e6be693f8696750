"""Order-insensitive comparison of query results."""

from __future__ import annotations

import math

import pandas as pd


def _value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.6g}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(_value(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def same(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> None:
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    assert rows(spark_frame) == rows(sql_frame)

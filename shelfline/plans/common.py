"""Shared pieces of the registered queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = dt.date(1998, 1, 1), dt.date(1999, 12, 31)
AS_OF = dt.date(2000, 6, 30)


def num(column: str | Column, digits: int = 4) -> Column:
    """A double rounded half away from zero, so that engines with other sum orders agree.

    Written as scaled integer arithmetic on doubles, the way the checking engine rounds: its result
    for values like 1.00005 depends on that.
    """
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    scale = F.lit(10.0**digits)
    return F.when(F.abs(c) < 1e12, F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale).otherwise(c)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: num(c, digits) for c in columns})


def r(expr: str, name: str, digits: int = 4) -> str:
    """The SQL twin of ``num``."""
    return f"round(cast({expr} as double), {digits}) as {name}"

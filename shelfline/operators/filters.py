"""Filters, text search, paging and lookups over any table of the star."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.operators.scale import page_of

MAX_RANGE_DAYS = 730
MIN_SEARCH_CHARS = 2


def check_range(start: dt.date, end: dt.date, max_days: int = MAX_RANGE_DAYS) -> None:
    if end < start:
        raise ValueError(f"end {end} lies before start {start}")
    if (end - start).days > max_days:
        raise ValueError(f"{(end - start).days} days asked for, at most {max_days} allowed")


def date_range(df: DataFrame, start: dt.date, end: dt.date, max_days: int = MAX_RANGE_DAYS) -> DataFrame:
    """Rows between two days, both inclusive."""
    check_range(start, end, max_days)
    return df.where(F.col("date").between(start, end))


def equals(df: DataFrame, **wanted: Any) -> DataFrame:
    """Equality filters; a value of ``None`` means "not asked for"."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def search(df: DataFrame, columns: Sequence[str], text: str | None) -> DataFrame:
    """Case-insensitive "contains" over any of ``columns``; ``%`` and ``_`` in ``text`` are wildcards.

    A text shorter than two characters does not filter.
    """
    if text is None or len(text) < MIN_SEARCH_CHARS:
        return df
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.col(column).ilike(f"%{text}%"), F.lit(False))
    return df.where(found)


def paginate(df: DataFrame, order: Sequence[str], page: int, size: int) -> DataFrame:
    """One page plus the size of the whole filtered set in ``total``.

    ``order`` names columns, with a minus in front for descending ones; it must be total (end it with a unique key).
    """
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return page_of(df, order, page, size).withColumn("total", total)


def lookup(df: DataFrame, **key: Any) -> DataFrame:
    """The row with this id or natural key, or no row."""
    if not key:
        raise ValueError("give at least one key column")
    return equals(df, **key)


def member_of(df: DataFrame, column: str, values: Any) -> DataFrame:
    """``column`` is one of ``values`` (a single value is allowed)."""
    values = [values] if isinstance(values, (str, int, float)) else list(values)
    return df.where(F.col(column).isin(values))


def json_equals(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """Field ``key`` of a JSON text column equals ``value``."""
    return df.where(F.get_json_object(F.col(column), f"$['{key}']") == F.lit(value))


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df


def stock_bucket(on_hand: Column, units: Column) -> Column:
    """LOW below two days of sales, MEDIUM below seven, else OK (also when nothing is known)."""
    return F.when(on_hand < units * 2, "LOW").when(on_hand < units * 7, "MEDIUM").otherwise("OK")


def discount_pct(list_price: Column, sale_price: Column) -> Column:
    """Percent below list price; NULL without a list price, 0 for a list price of 0."""
    pct = F.round((list_price - sale_price) / F.nullif(list_price, F.lit(0)) * 100, 2)
    return F.when(list_price.isNull(), None).when(list_price == 0, F.lit(0)).otherwise(pct)

"""Windows over series that are too long for one task.

The rows of all series are numbered in the order (series, date) by range partitioning, so neither a
long series nor a burst of rows on one day has to fit into a task.  The numbered rows are cut every
``block_rows`` rows, and each cut also gets the last rows of the cut before it (the halo), which is
all that a lag or a rolling window can read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.operators.scale import global_row_number

INDEX = "_idx"


def with_row_index(df: DataFrame, entity: Sequence[str], date: str) -> DataFrame:
    """Position of each row in the order of series and date (which is unique within a series)."""
    return global_row_number(df, [F.col(c) for c in (*entity, date)], INDEX)


def _attach(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary columns of the block of each row; NULL entity values match each other."""
    renamed = summary.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    return rows.join(renamed, test, "inner").drop(*[f"_s_{k}" for k in keys])


def with_halo(df: DataFrame, lookback: int, block_rows: int) -> DataFrame:
    """Numbered rows with their block, plus a copy of the last ``lookback`` rows of each block for the next one."""
    if block_rows < lookback:
        raise ValueError(f"block_rows must be at least the lookback of {lookback} rows")
    block = F.floor(F.col(INDEX) / block_rows).cast("long")
    targets = F.when(
        F.col(INDEX) % block_rows >= block_rows - lookback, F.array(block, block + 1)
    ).otherwise(F.array(block))
    return (
        df.withColumn("_block", F.explode(targets)).withColumn("_halo", F.col("_block") > block).drop(INDEX)
    )


def block_window(entity: Sequence[str], date: str):
    return Window.partitionBy(*entity, "_block").orderBy(date)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_halo", "_block")


def fill(df: DataFrame, column: str, strategy: str, entity: Sequence[str], block_rows: int) -> DataFrame:
    """``ffill``, ``bfill``, ``mean`` or ``expanding_mean`` over numbered rows and one summary row per block."""
    numbered = df.withColumn("_block", F.floor(F.col(INDEX) / block_rows))
    value = F.col(column)
    keys = [*entity, "_block"]
    known = F.when(value.isNotNull(), F.col(INDEX))
    summary = numbered.groupBy(*keys).agg(
        F.min_by(value, known).alias("_first"),
        F.max_by(value, known).alias("_last"),
        F.sum(value).alias("_sum"),
        F.count(value).alias("_n"),
    )
    w = Window.partitionBy(*entity).orderBy("_block")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*entity).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*entity)
    carried = summary.select(
        *keys,
        F.last("_last", ignorenulls=True).over(earlier).alias("_past"),
        F.last("_first", ignorenulls=True).over(later).alias("_next"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_past_sum"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_past_n"),
        F.sum("_sum").over(whole).alias("_all_sum"),
        F.sum("_n").over(whole).alias("_all_n"),
    )
    joined = _attach(numbered, carried, keys)
    local = Window.partitionBy(*keys).orderBy(INDEX)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    if strategy == "ffill":
        seen = F.last(value, ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0))
        filled = F.coalesce(seen, F.col("_past"))
    elif strategy == "bfill":
        back = Window.partitionBy(*keys).orderBy(F.desc(INDEX)).rowsBetween(Window.unboundedPreceding, 0)
        seen = F.last(value, ignorenulls=True).over(back)
        filled = F.coalesce(seen, F.col("_next"))
    elif strategy == "mean":
        filled = F.coalesce(value, F.try_divide(F.col("_all_sum"), F.col("_all_n")))
    else:
        total = F.col("_past_sum") + F.coalesce(F.sum(value).over(before), F.lit(0))
        filled = F.coalesce(value, F.try_divide(total, F.col("_past_n") + F.count(value).over(before)))
    return joined.withColumn("_filled", filled).select(
        *[F.col("_filled").alias(c) if c == column else F.col(c) for c in df.columns]
    )

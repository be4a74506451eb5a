"""Leakage-safe features for every series at once.

Lags and windows count rows of the series, not days, as a series may miss days.  All windows share
one partitioning and one order, so Spark plans one shuffle and one sort for the whole set.

A daily series has one row per entity and day, so no window partition is longer than the calendar
(a few thousand rows for ten years), however hot the entity is: ``daily_series`` combines its rows
before the shuffle.  For frames with many rows per entity (not daily) pass ``block_rows``: the
series is then cut into blocks that are processed by different tasks, see ``blocks.py``.
"""

from __future__ import annotations

import datetime as dt
import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import blocks
from shelfline.functions.config import (
    CalendarConfig,
    ExogenousConfig,
    FeatureSetConfig,
    ImputationConfig,
    LagConfig,
    RollingConfig,
)

_AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
_FUTURE = {"bfill", "mean"}


@dataclass(frozen=True)
class FeatureResult:
    df: DataFrame
    feature_columns: list[str]
    config_hash: str
    source: DataFrame

    def null_counts(self) -> DataFrame:
        """One row per feature: nulls, with input rows, output rows and number of features."""
        counts = [F.count_if(F.col(c).isNull()).alias(c) for c in self.feature_columns]
        one_row = self.df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
        pairs = F.array(
            *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("nulls")) for c in self.feature_columns]
        )
        return (
            one_row.select(F.col("_rows").alias("output_rows"), F.explode(pairs).alias("_p"))
            .withColumn("input_rows", self.source.agg(F.count(F.lit(1))).scalar())
            .withColumn("feature_count", F.lit(len(self.feature_columns)))
            .select("_p.feature", "_p.nulls", "input_rows", "output_rows", "feature_count")
        )


def series_window(entity: Sequence[str], date: str = "date"):
    return Window.partitionBy(*entity).orderBy(date)


def cutoff(df: DataFrame, last_day: dt.date | None, lookback_days: int | None = None, date: str = "date") -> DataFrame:
    """Rows up to ``last_day``; with ``lookback_days`` only the days from ``last_day - lookback_days`` on."""
    if last_day is None:
        return df
    df = df.where(F.col(date) <= F.lit(last_day))
    if lookback_days is not None:
        df = df.where(F.col(date) >= F.lit(last_day - dt.timedelta(days=lookback_days)))
    return df


# -- imputation -----------------------------------------------------------------


def impute(
    df: DataFrame,
    config: ImputationConfig,
    entity: Sequence[str],
    date: str = "date",
    block_rows: int | None = None,
) -> DataFrame:
    """Fill nulls column by column in the order of the config; absent columns are ignored."""
    number_here = block_rows is not None and blocks.INDEX not in df.columns
    if number_here:
        df = blocks.with_row_index(df, entity, date)
    for column, strategy in config.strategies.items():
        if column not in df.columns:
            continue
        if strategy in _FUTURE:
            warnings.warn(f"{strategy} on {column} uses future values", stacklevel=2)
        if strategy == "zero":
            df = df.withColumn(column, F.coalesce(F.col(column), F.lit(0)))
        elif strategy == "drop":
            df = df.dropna(subset=[column])
        elif block_rows is not None:
            df = blocks.fill(df, column, strategy, entity, block_rows)
        else:
            df = df.withColumn(column, _filled(column, strategy, entity, date))
    return df.drop(blocks.INDEX) if number_here else df


def _filled(column: str, strategy: str, entity: Sequence[str], date: str) -> Column:
    value = F.col(column)
    w = series_window(entity, date)
    if strategy == "ffill":
        return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if strategy == "bfill":
        # a running "last" over the reversed series: Spark evaluates frames that end at
        # "unbounded following" from scratch for every row
        back = Window.partitionBy(*entity).orderBy(F.desc(date))
        return F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    if strategy == "mean":
        return F.coalesce(value, F.avg(value).over(Window.partitionBy(*entity)))
    # expanding_mean: earlier rows only
    return F.coalesce(value, F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))


# -- feature columns --------------------------------------------------------------


def lag_columns(config: LagConfig, w) -> dict[str, Column]:
    out = {}
    for k in config.lags:
        column = F.lag(config.target_column, k).over(w)
        if config.fill_value is not None:
            column = F.coalesce(column, F.lit(config.fill_value))
        out[f"lag_{k}"] = column
    return out


def with_rolling(df: DataFrame, config: RollingConfig, w) -> tuple[DataFrame, list[str]]:
    """Statistics of the rows before the current one; ``min_periods`` counts values that are not null.

    The work for a row does not grow with the windows: counts, sums and squares about the first value of the
    series (no later one, so nothing leaks) are differences of running sums, and a minimum over n rows is that of two overlapping spans of a
    power of two, each made of two spans half as long.  All steps share one partitioning and one order.
    A window of doubles that holds NaN or an infinity has NaN for mean, std and sum.
    """
    target, kind = F.col(config.target_column), df.schema[config.target_column].dataType
    wanted, windows = set(config.aggregations), list(config.windows)
    floating = isinstance(kind, (T.FloatType, T.DoubleType))
    summed = wanted & {"mean", "sum"}
    about = "std" in wanted or (floating and bool(summed))  # sums about a value keep their digits
    finite = F.abs(target) < F.lit(float("inf"))
    value = F.when(finite, target).cast("double") if floating else target.cast("double")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    columns = list(df.columns)
    if about:
        df = df.withColumn("_r_first", F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    off = value - F.col("_r_first")
    running = {"_r_n": F.count(target)}
    if floating:
        running["_r_odd"] = F.count(F.when(~finite, 1))
    if about:
        running |= {"_r_off": F.sum(off), "_r_square": F.sum(off * off)}
    if summed and not floating:
        running["_r_sum"] = F.sum(target)
    extremes = {name: pick for name, pick in (("min", F.least), ("max", F.greatest)) if name in wanted}
    df = df.withColumns({c: F.coalesce(f.over(before), F.lit(0)) for c, f in running.items()} | {f"_r_{m}0": F.lag(target, 1).over(w) for m in extremes})
    steps = {f"{c}_{n}": F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0)) for c in running for n in windows}
    for level in range(1, max(windows).bit_length() if extremes else 1):
        half = 1 << (level - 1)
        steps |= {f"_r_{m}{level}": pick(f"_r_{m}{level - 1}", F.lag(f"_r_{m}{level - 1}", half).over(w)) for m, pick in extremes.items()}
        df, steps = df.withColumns(steps), {}
    for n in windows:
        level = n.bit_length() - 1
        for m, pick in extremes.items():
            span = F.col(f"_r_{m}{level}")
            steps[f"_r_{m}_{n}"] = pick(span, F.lag(span, n - (1 << level)).over(w)) if n > 1 << level else span
    df = df.withColumns(steps) if steps else df

    kinds = dict(df.agg(*[_AGGREGATES[a](target).alias(a) for a in config.aggregations]).dtypes)
    out = {}
    for n in windows:
        count = F.col(f"_r_n_{n}")
        enough = count >= (n if config.min_periods is None else config.min_periods)
        odd = F.col(f"_r_odd_{n}") > 0 if floating else F.lit(False)
        if floating and summed:
            total = F.when(count > 0, F.col(f"_r_off_{n}") + F.coalesce("_r_first", F.lit(0.0)) * count)
        elif summed:
            total = F.when(count > 0, F.col(f"_r_sum_{n}"))
        made = {f"{m}": F.col(f"_r_{m}_{n}") for m in extremes}
        if summed:
            made |= {"sum": F.when(odd, F.lit(float("nan"))).otherwise(total) if floating else total}
            made |= {"mean": F.try_divide(made["sum"], count)}
        if "std" in wanted:
            squares = F.col(f"_r_square_{n}") - F.try_divide(F.col(f"_r_off_{n}") * F.col(f"_r_off_{n}"), count)
            std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(squares, count - 1)))
            made["std"] = F.when(count > 1, F.when(odd, F.lit(float("nan"))).otherwise(std))
        for name in config.aggregations:
            out[f"rolling_{name}_{n}"] = F.when(enough, made[name].cast(kinds[name]))
    return df.withColumns(out).select(*columns, *out), list(out)


def calendar_columns(config: CalendarConfig, date: str = "date", available: Sequence[str] = ()) -> dict[str, Column]:
    """Columns of the day; ``is_holiday`` where the rows bring the flag of the calendar table (NULL: no holiday)."""
    day = F.col(date)
    out: dict[str, Column] = {}

    def cycle(name: str, value: Column, length: int, raw: str) -> None:
        if config.use_cyclical_encoding:
            angle = value * F.lit(2 * math.pi / length)
            out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
        else:
            out[raw] = value

    if config.include_day_of_week:
        cycle("dow", F.weekday(day), 7, "day_of_week")
    if config.include_month:
        cycle("month", F.month(day), 12, "month")
    if config.include_quarter:
        out["quarter"] = F.quarter(day)
    if config.include_year:
        out["year"] = F.year(day)
    if config.include_is_weekend:
        out["is_weekend"] = (F.weekday(day) >= 5).cast("int")
    if config.include_is_month_end:
        out["is_month_end"] = (day == F.last_day(day)).cast("int")
    if config.include_is_holiday and "is_holiday" in available:
        out["is_holiday"] = F.coalesce(F.col("is_holiday"), F.lit(False)).cast("int")
    return out


def exogenous_columns(config: ExogenousConfig, available: Sequence[str], w) -> dict[str, Column]:
    """Lagged price, stock and promotion signals; a zero base price gives a NULL change."""
    out: dict[str, Column] = {}
    if config.include_price and "unit_price" in available:
        for k in config.price_lags:
            out[f"price_lag_{k}"] = F.lag("unit_price", k).over(w)
        if config.include_price_change:
            change = F.try_divide(F.lag("unit_price", 1).over(w), F.lag("unit_price", 8).over(w)) - 1
            out["price_pct_change_7d"] = change
    if config.include_stockout_flag and "is_stockout" in available:
        out["stockout_lag_1"] = F.lag("is_stockout", 1).over(w)
    if config.include_promo and "on_promotion" in available:
        out["promo_lag_1"] = F.lag("on_promotion", 1).over(w)
    if config.include_inventory and "on_hand_qty" in available:
        out["on_hand_lag_1"] = F.lag("on_hand_qty", 1).over(w)
    return out


def _lookback(config: FeatureSetConfig) -> int:
    """Rows before the current one that any feature reads."""
    spans = [1]
    if config.lag_config:
        spans += config.lag_config.lags
    if config.rolling_config:
        spans += config.rolling_config.windows
    if config.exogenous_config:
        spans += [*config.exogenous_config.price_lags, 8]
    return max(spans)


def compute_features(
    df: DataFrame,
    config: FeatureSetConfig,
    cutoff_date: dt.date | None = None,
    block_rows: int | None = None,
) -> FeatureResult:
    """Cutoff, imputation, then lag, rolling, calendar and exogenous columns, in this order."""
    entity, date = config.entity_columns, config.date_column
    rows = cutoff(df, cutoff_date, date=date)
    if block_rows is not None:
        rows = blocks.with_row_index(rows, entity, date)
    if config.imputation_config:
        rows = impute(rows, config.imputation_config, entity, date, block_rows)
    w = series_window(entity, date)
    if block_rows is not None:
        if config.imputation_config and "drop" in config.imputation_config.strategies.values():
            # dropped rows leave holes in the numbers, and a halo counts rows
            rows = blocks.with_row_index(rows.drop(blocks.INDEX), entity, date)
        rows = blocks.with_halo(rows, _lookback(config), block_rows)
        w = blocks.block_window(entity, date)
    given, rolled, columns = rows.columns, [], {}
    if config.rolling_config:
        rows, rolled = with_rolling(rows, config.rolling_config, w)
    if config.lag_config:
        columns |= lag_columns(config.lag_config, w)
    lagged = list(columns)
    if config.calendar_config:
        columns |= calendar_columns(config.calendar_config, date, rows.columns)
    if config.exogenous_config:
        columns |= exogenous_columns(config.exogenous_config, rows.columns, w)
    names = [*lagged, *rolled, *(c for c in columns if c not in lagged)]
    rows = rows.withColumns(columns) if columns else rows
    rows = rows.select(*given, *[c for c in names if c not in given])
    if block_rows is not None:
        rows = blocks.drop_halo(rows)
    return FeatureResult(rows, names, config.config_hash(), df)


def preview(
    df: DataFrame, config: FeatureSetConfig, cutoff_date: dt.date, n: int, lookback_days: int = 365
) -> DataFrame:
    """The last ``n`` feature rows of every series, computed from one year of history."""
    recent = cutoff(df, cutoff_date, lookback_days, config.date_column)
    result = compute_features(recent, config, cutoff_date).df
    latest = Window.partitionBy(*config.entity_columns).orderBy(F.desc(config.date_column))
    return result.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= n).drop("_rn")


# -- the two plain reports ----------------------------------------------------------


def daily_lags(df: DataFrame, entity: Sequence[str], start: dt.date, end: dt.date) -> DataFrame:
    """Quantity 1 and 7 rows ago; the period is cut after the window, rows without a 7-row lag are left out."""
    w = series_window(entity)
    lagged = df.where(F.col("date") <= F.lit(end)).select(
        *entity,
        "date",
        "quantity",
        F.lag("quantity", 1).over(w).alias("quantity_lag_1d"),
        F.lag("quantity", 7).over(w).alias("quantity_lag_7d"),
    )
    return lagged.where(F.col("date").between(start, end) & F.col("quantity_lag_7d").isNotNull())


def moving_average(df: DataFrame, entity: Sequence[str], start: dt.date, end: dt.date) -> DataFrame:
    """Mean and standard deviation of up to seven earlier rows, with no minimum number of rows."""
    before = series_window(entity).rowsBetween(-7, -1)
    rolled = df.where(F.col("date") <= F.lit(end)).select(
        *entity,
        "date",
        "quantity",
        F.round(F.avg("quantity").over(before), 2).alias("quantity_ma_7d"),
        F.round(F.stddev_samp("quantity").over(before), 2).alias("quantity_std_7d"),
    )
    return rolled.where(F.col("date").between(start, end))

"""Forecast error measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
METRICS = ("mae", "smape", "wape", "bias")
SIGNED = ("bias",)


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def smape(actual: Column, predicted: Column) -> Column:
    """0..200; a pair of zeros is a perfect forecast."""
    size = F.abs(actual) + F.abs(predicted)
    return F.avg(F.when(size == 0, 0.0).otherwise(F.try_divide(2 * F.abs(actual - predicted), size))) * 100


def wape(actual: Column, predicted: Column) -> Column:
    """Infinite when the actuals sum to zero."""
    total = F.sum(F.abs(actual))
    return F.when(total == 0, F.lit(INF)).otherwise(F.try_divide(F.sum(F.abs(actual - predicted)), total) * 100)


def bias(actual: Column, predicted: Column) -> Column:
    """Positive: the forecast is too low."""
    return F.avg(actual - predicted)


def fold_metrics(actual: Column, predicted: Column) -> list[Column]:
    """The four measures, the number of samples and the warning columns."""
    error = actual - predicted
    spread = F.stddev_pop(error)
    return [
        mae(actual, predicted).alias("mae"),
        smape(actual, predicted).alias("smape"),
        wape(actual, predicted).alias("wape"),
        bias(actual, predicted).alias("bias"),
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if((actual == 0) | (predicted == 0)).alias("zero_samples"),
        (F.sum(F.abs(actual)) == 0).alias("zero_actuals"),
        F.coalesce((spread > 0) & (F.abs(F.avg(error)) > spread), F.lit(False)).alias("systematic_bias"),
    ]


def fold_mean(value: Column) -> Column:
    """Mean over the folds that have a value."""
    return F.coalesce(F.avg(F.when(~F.isnan(value), value)), F.lit(float("nan")))


def stability(value: Column) -> Column:
    """Coefficient of variation over folds in percent: NaN below two folds, infinite for a mean of zero."""
    valid = F.when(~F.isnan(value), value)
    mean = F.avg(valid)
    return (
        F.when(F.count(valid) < 2, F.lit(float("nan")))
        .when(mean == 0, F.lit(INF))
        .otherwise(F.try_divide(F.stddev_pop(valid), F.abs(mean)) * 100)
    )

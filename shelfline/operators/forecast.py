"""Baseline forecasts: fit and predict as grouped expressions over all series.

Every model needs only the last few values of a series, so a fitted model is one row: the series
key and an array of at most ``tail`` values.
"""

from __future__ import annotations

import datetime as dt
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.config import canonical_hash

MAX_HORIZON = 90


@dataclass(frozen=True, kw_only=True)
class ModelConfig:
    """``naive`` repeats the last value, ``seasonal_naive`` the last season, ``moving_average`` the mean of the last window."""

    model_type: str
    season_length: int = 7
    window_size: int = 7

    def __post_init__(self):
        if self.model_type not in ("naive", "seasonal_naive", "moving_average"):
            raise ValueError(f"unknown model {self.model_type!r}")
        if self.season_length < 1 or self.window_size < 1:
            raise ValueError("season_length and window_size start at 1")

    @property
    def tail(self) -> int:
        """Values the model reads, and so the least a series must have."""
        return {"naive": 1, "seasonal_naive": self.season_length, "moving_average": self.window_size}[
            self.model_type
        ]

    def config_hash(self) -> str:
        return canonical_hash(asdict(self), sort_keys=True)


NAIVE = ModelConfig(model_type="naive")
SEASONAL = ModelConfig(model_type="seasonal_naive")
MOVING = ModelConfig(model_type="moving_average")


def predict_column(model: ModelConfig, tail: Column, step: Column) -> Column:
    """Forecast number ``step`` (0-based) from the last ``model.tail`` values, oldest first."""
    if model.model_type == "moving_average":
        total = F.aggregate(tail, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
        return total / F.size(tail)
    return F.element_at(tail, (F.pmod(step, F.lit(model.tail)) + 1).cast("int"))


def check_horizon(horizon: int) -> None:
    if not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon must lie in 1..{MAX_HORIZON}")


def fit(
    series: DataFrame,
    start: dt.date,
    end: dt.date,
    model: ModelConfig,
    entity: Sequence[str] = ("store_id", "product_id"),
    target: str = "quantity",
) -> tuple[DataFrame, DataFrame]:
    """Fitted states and rejected series (fewer values than the model needs).

    One shuffle by series; a daily series has at most one row per day of the period.
    """
    rows = series.where(F.col("date").between(start, end)).select(
        *entity, "date", F.col(target).cast("double").alias("y")
    )
    whole = Window.partitionBy(*entity)
    state = (
        rows.withColumn("_rn", F.row_number().over(whole.orderBy(F.desc("date"))))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .where(F.col("_rn") <= model.tail)
        .groupBy(*entity)
        .agg(F.max("_n").alias("n_obs"), F.array_sort(F.collect_list(F.struct("date", "y"))).alias("_tail"))
        .select(
            *entity,
            F.lit(model.model_type).alias("model_type"),
            F.lit(model.config_hash()).alias("config_hash"),
            F.lit(start).alias("train_start"),
            F.lit(end).alias("train_end"),
            "n_obs",
            F.transform("_tail", lambda p: p["y"]).alias("last_values"),
        )
    )
    enough = F.col("n_obs") >= model.tail
    rejected = state.where(~enough).select(
        *entity, "model_type", "n_obs", F.lit(f"needs {model.tail} values").alias("reason")
    )
    return state.where(enough), rejected


def forecast(state: DataFrame, model: ModelConfig, horizon: int, entity: Sequence[str] = ("store_id", "product_id")) -> DataFrame:
    """``horizon`` days after the requested training end (not after the last observed day)."""
    check_horizon(horizon)
    return state.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *entity,
        "model_type",
        "config_hash",
        "step",
        F.date_add("train_end", F.col("step")).alias("date"),
        predict_column(model, F.col("last_values"), F.col("step") - 1).alias("forecast"),
        F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"),
    )


# -- own models -------------------------------------------------------------------


class Forecaster(ABC):
    """A user model for one series; ``fit`` sees the values in date order."""

    @abstractmethod
    def fit(self, y: np.ndarray) -> Forecaster: ...

    @abstractmethod
    def predict(self, horizon: int) -> np.ndarray: ...


_FACTORIES: dict[str, Callable[[], Forecaster]] = {}


def register_forecaster(name: str, factory: Callable[[], Forecaster]) -> None:
    _FACTORIES[name] = factory


def forecast_custom(
    series: DataFrame,
    name: str,
    start: dt.date,
    end: dt.date,
    horizon: int,
    entity: Sequence[str] = ("store_id", "product_id"),
    target: str = "quantity",
) -> DataFrame:
    """Fit and predict a registered model per series in Python workers.

    A group is one daily series inside ``start``..``end``: at most one row per day of that period.
    """
    check_horizon(horizon)
    factory = _FACTORIES[name]
    days = (end - start).days + 1
    rows = series.where(F.col("date").between(start, end)).select(
        *entity, "date", F.col(target).cast("double").alias("y")
    )
    keys = list(entity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > days:
            raise ValueError("more than one row per day: aggregate the series to days first")
        y = pdf.sort_values("date")["y"].to_numpy(dtype=float)
        values = np.asarray(factory().fit(y).predict(horizon), dtype=float)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * horizon for k in keys})
        out["model_type"] = name
        out["step"] = np.arange(1, horizon + 1, dtype=np.int32)
        out["date"] = [end + dt.timedelta(days=h) for h in range(1, horizon + 1)]
        out["forecast"] = values
        return out

    schema = T.StructType(
        [f for f in rows.schema.fields if f.name in keys]
        + [
            T.StructField("model_type", T.StringType()),
            T.StructField("step", T.IntegerType()),
            T.StructField("date", T.DateType()),
            T.StructField("forecast", T.DoubleType()),
        ]
    )
    return rows.groupBy(*keys).applyInPandas(run, schema)

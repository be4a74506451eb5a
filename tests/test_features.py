"""Feature engineering: exact values, no look-ahead, same numbers as pandas."""

import datetime as dt
import json
import hashlib
import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfline.functions import blocks, features
from shelfline.functions.config import (
    AGGREGATIONS,
    CalendarConfig,
    ExogenousConfig,
    FeatureSetConfig,
    ImputationConfig,
    LagConfig,
    RollingConfig,
)

DAY0 = dt.date(2024, 1, 1)
SCHEMA = "date date, store_id int, product_id int, quantity double, unit_price double"
FULL = FeatureSetConfig(
    lag_config=LagConfig(lags=(1, 7)),
    rolling_config=RollingConfig(windows=(7,)),
    calendar_config=CalendarConfig(),
    exogenous_config=ExogenousConfig(price_lags=(7,)),
    imputation_config=ImputationConfig(strategies={"quantity": "zero", "unit_price": "ffill"}),
)


def series(spark, values, store=1, product=1, prices=None):
    return spark.createDataFrame(
        [(DAY0 + dt.timedelta(days=i), store, product, None if v is None else float(v),
          float(prices[i]) if prices and prices[i] is not None else (None if prices else 10.0))
         for i, v in enumerate(values)],
        SCHEMA,
    )


def column(result, name, **where):
    df = result.df if hasattr(result, "df") else result
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return [r[name] for r in df.orderBy("date").collect()]


def test_lag_takes_earlier_rows(spark):
    out = features.compute_features(series(spark, range(1, 31)), FeatureSetConfig(lag_config=LagConfig(lags=(1, 7))))
    assert column(out, "lag_1") == [None, *map(float, range(1, 30))]
    assert column(out, "lag_7") == [None] * 7 + [float(v) for v in range(1, 24)]
    assert out.feature_columns == ["lag_1", "lag_7"]


def test_lag_fill_value(spark):
    cfg = FeatureSetConfig(lag_config=LagConfig(lags=(2,), fill_value=-1.0))
    assert column(features.compute_features(series(spark, [5, 6, 7]), cfg), "lag_2") == [-1.0, -1.0, 5.0]


def test_lag_counts_rows_not_days(spark):
    gappy = series(spark, range(1, 11)).where(F.col("quantity") != 5)
    out = features.compute_features(gappy, FeatureSetConfig(lag_config=LagConfig(lags=(1,))))
    assert column(out, "lag_1")[4] == 4.0


def test_rolling_excludes_the_current_row(spark):
    cfg = FeatureSetConfig(rolling_config=RollingConfig(windows=(7,), aggregations=("mean", "sum")))
    out = features.compute_features(series(spark, range(1, 31)), cfg)
    mean = column(out, "rolling_mean_7")
    assert mean[:7] == [None] * 7 and mean[7] == 4.0 and mean[29] == 26.0


def test_series_do_not_mix(spark):
    a, b = series(spark, range(1, 11)), series(spark, range(101, 111), product=2)
    out = features.compute_features(a.unionByName(b), FeatureSetConfig(lag_config=LagConfig(lags=(1,))))
    assert column(out, "lag_1", product_id=2) == [None, *map(float, range(101, 110))]


def test_cutoff_comes_first(spark):
    out = features.compute_features(series(spark, range(1, 31)), FULL, DAY0 + dt.timedelta(days=9))
    assert len(column(out, "date")) == 10


@pytest.mark.parametrize("block_rows", [None, 10])
def test_later_values_never_change_earlier_features(spark, block_rows):
    t = 20
    plain = [float(v % 5) if v % 4 else None for v in range(40)]
    other = plain[:t] + [v * 1000 + 7 if v is not None else 3.0 for v in plain[t:]]
    cfg = FULL
    a = features.compute_features(series(spark, plain, prices=[v + 1 if v else None for v in plain]), cfg, None, block_rows)
    b = features.compute_features(
        series(spark, other, prices=[v + 1 if v else None for v in plain[:t]] + [9.0] * 20), cfg, None, block_rows
    )
    last = DAY0 + dt.timedelta(days=t - 1)
    pick = lambda r: r.df.where(F.col("date") <= last).orderBy("date").select(*r.feature_columns).collect()
    assert pick(a) == pick(b)


def _pandas(frame, f):
    return frame.groupby(["store_id", "product_id"])["quantity"].transform(f).tolist()


def _same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None or math.isnan(g)
        else:
            assert g == pytest.approx(w, abs=1e-9)


@pytest.fixture
def random_frame():
    rng = np.random.default_rng(4)
    parts = []
    for s in (1, 2):
        for p in (1, 2, 3):
            n = int(rng.integers(20, 60))
            q = rng.integers(0, 50, n).astype(float)
            q[rng.random(n) < 0.25] = np.nan
            parts.append(pd.DataFrame({
                "date": [DAY0 + dt.timedelta(days=int(d)) for d in np.sort(rng.choice(100, n, replace=False))],
                "store_id": s, "product_id": p, "quantity": q, "unit_price": 1.0}))
    return pd.concat(parts, ignore_index=True)


def _frame(spark, pdf):
    data = [(r.date, int(r.store_id), int(r.product_id), None if math.isnan(r.quantity) else float(r.quantity), 1.0)
            for r in pdf.itertuples()]
    return spark.createDataFrame(data, SCHEMA)


def _ordered(df, name):
    return [r[name] for r in df.orderBy("store_id", "product_id", "date").collect()]


@pytest.mark.parametrize("min_periods", [7, 3, 1])
@pytest.mark.parametrize("block_rows", [None, 10])
def test_rolling_equals_pandas(spark, random_frame, min_periods, block_rows):
    cfg = FeatureSetConfig(rolling_config=RollingConfig(windows=(7,), aggregations=AGGREGATIONS, min_periods=min_periods))
    out = features.compute_features(_frame(spark, random_frame), cfg, None, block_rows).df
    for name in AGGREGATIONS:
        want = _pandas(random_frame, lambda x, a=name: x.shift(1).rolling(7, min_periods=min_periods).agg(a))
        _same(_ordered(out, f"rolling_{name}_7"), want)


PANDAS_FILL = {
    "zero": lambda x: x.fillna(0),
    "ffill": lambda x: x.ffill(),
    "bfill": lambda x: x.bfill(),
    "mean": lambda x: x.fillna(x.mean()),
    "expanding_mean": lambda x: x.fillna(x.expanding(min_periods=1).mean().shift(1)),
}


@pytest.mark.parametrize("strategy", PANDAS_FILL)
@pytest.mark.parametrize("block_rows", [None, 5])
def test_imputation_equals_pandas(spark, random_frame, strategy, block_rows):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        cfg = ImputationConfig(strategies={"quantity": strategy, "absent": "zero"})
        out = features.impute(_frame(spark, random_frame), cfg, ["store_id", "product_id"], "date", block_rows)
    _same(_ordered(out, "quantity"), _pandas(random_frame, PANDAS_FILL[strategy]))


def test_imputation_drop_and_warning(spark):
    cfg = ImputationConfig(strategies={"quantity": "drop"})
    assert features.impute(series(spark, [1, None, 3]), cfg, ["store_id"]).count() == 2
    with pytest.warns(UserWarning, match="future"):
        features.impute(series(spark, [1]), ImputationConfig(strategies={"quantity": "mean"}), ["store_id"])


def test_price_change_uses_past_prices(spark):
    prices = [10.0, 11, 12, 13, 14, 15, 16, 20, 99, 0, 5]
    out = features.compute_features(
        series(spark, range(11), prices=prices), FeatureSetConfig(exogenous_config=ExogenousConfig(price_lags=(7,)))
    )
    change = column(out, "price_pct_change_7d")
    assert change[:8] == [None] * 8 and change[8] == pytest.approx(20 / 10 - 1)


def test_zero_base_price_gives_null(spark):
    prices = [0.0] + [5.0] * 9
    out = features.compute_features(series(spark, range(10), prices=prices), FeatureSetConfig(exogenous_config=ExogenousConfig()))
    assert column(out, "price_pct_change_7d")[8] is None


def test_calendar_columns(spark):
    out = features.compute_features(series(spark, range(31)), FeatureSetConfig(calendar_config=CalendarConfig()))
    monday = out.df.orderBy("date").first()
    assert monday.dow_sin == pytest.approx(0) and monday.dow_cos == pytest.approx(1)
    assert monday.month_sin == pytest.approx(math.sin(2 * math.pi / 12))
    assert column(out, "is_month_end")[-1] == 1 and column(out, "is_weekend")[:7] == [0] * 5 + [1] * 2


def test_null_counts_and_preview(spark):
    cfg = FeatureSetConfig(lag_config=LagConfig(lags=(1, 7)))
    result = features.compute_features(series(spark, range(10)), cfg, DAY0 + dt.timedelta(days=7))
    got = {r.feature: (r.nulls, r.input_rows, r.output_rows, r.feature_count) for r in result.null_counts().collect()}
    assert got == {"lag_1": (1, 10, 8, 2), "lag_7": (7, 10, 8, 2)}
    last = features.preview(series(spark, range(10)), cfg, DAY0 + dt.timedelta(days=7), 3)
    assert column(last, "lag_1") == [4.0, 5.0, 6.0]


def test_empty_frame(spark):
    out = features.compute_features(series(spark, [1]).limit(0), FULL)
    assert out.df.count() == 0 and "lag_1" in out.df.columns


def test_config_rules_and_hash():
    for bad in (lambda: LagConfig(lags=()), lambda: LagConfig(lags=(0,)), lambda: RollingConfig(windows=(-1,)),
                lambda: RollingConfig(aggregations=("median",)), lambda: ExogenousConfig(price_lags=(0,)),
                lambda: ImputationConfig(strategies={"quantity": "guess"})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        LagConfig(lag=(1,))
    text = json.dumps({"schema_version": "1.0", "lags": [1], "target_column": "quantity", "fill_value": None}, separators=(",", ":"))
    assert LagConfig(lags=(1,)).config_hash() == hashlib.sha256(text.encode()).hexdigest()[:16]
    assert FULL.enabled_features() == ["lag", "rolling", "calendar", "exogenous"]


def test_one_shuffle_for_all_features(spark):
    plan = features.compute_features(series(spark, range(30)), FULL).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_blocks_after_dropped_rows(spark):
    values = [None if i % 4 == 1 else i for i in range(60)]
    cfg = FeatureSetConfig(lag_config=LagConfig(lags=(1, 3)), imputation_config=ImputationConfig(strategies={"quantity": "drop"}))
    both = series(spark, values).unionByName(series(spark, values, product=2))
    plain = features.compute_features(both, cfg).df
    cut = features.compute_features(both, cfg, None, 10).df
    order = ["product_id", "date"]
    assert plain.orderBy(order).collect() == cut.select(plain.columns).orderBy(order).collect()


def test_row_index_orders_series_and_days(spark):
    df = series(spark, range(200)).unionByName(series(spark, range(50), product=2)).repartition(7)
    out = blocks.with_row_index(df, ["store_id", "product_id"], "date").orderBy("_idx").collect()
    assert [r["_idx"] for r in out] == list(range(1, 251))
    assert [(r.product_id, r.date) for r in out] == sorted((r.product_id, r.date) for r in out)

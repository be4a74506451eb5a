"""Forecasts, splits, backtests and error measures against plain Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.functions import metrics as M
from shelfline.operators import backtest as bt
from shelfline.operators import forecast as fc
from shelfline.sources import sinks
from shelfline.sources.star import daily_series, load_series

DAY0 = dt.date(2024, 1, 1)
KEY = ("store_id", "product_id")


def series(spark, values, store=1, product=1):
    data = [(DAY0 + dt.timedelta(days=i), store, product, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "date date, store_id int, product_id int, quantity double")


def predicted(spark, values, model, horizon, end=None):
    end = end or DAY0 + dt.timedelta(days=len(values) - 1)
    state, rejected = fc.fit(series(spark, values), DAY0, end, model)
    out = fc.forecast(state, model, horizon).orderBy("step").collect()
    return out, rejected.collect()


def test_naive_repeats_the_last_value(spark):
    out, _ = predicted(spark, [3, 9, 4], fc.NAIVE, 3)
    assert [r.forecast for r in out] == [4.0] * 3


def test_seasonal_naive_cycles_and_stops_midway(spark):
    out, _ = predicted(spark, [10, 20, 30, 40, 50, 60, 70] * 2, fc.SEASONAL, 10)
    assert [r.forecast for r in out] == [10, 20, 30, 40, 50, 60, 70, 10, 20, 30]


def test_moving_average(spark):
    out, _ = predicted(spark, range(1, 11), fc.MOVING, 2)
    assert [r.forecast for r in out] == [7.0, 7.0]


def test_dates_follow_the_requested_end(spark):
    end = DAY0 + dt.timedelta(days=30)
    out, _ = predicted(spark, [1, 2, 3], fc.NAIVE, 2, end)
    assert [r.date for r in out] == [end + dt.timedelta(days=1), end + dt.timedelta(days=2)]
    assert out[0].lower is None and out[0].upper is None


def test_short_series_are_rejected(spark):
    out, rejected = predicted(spark, [1, 2], fc.SEASONAL, 2)
    assert out == [] and rejected[0].n_obs == 2 and "7" in rejected[0].reason


def test_limits():
    with pytest.raises(ValueError):
        fc.check_horizon(91)
    with pytest.raises(ValueError):
        fc.ModelConfig(model_type="magic")
    for bad in ({"n_splits": 1}, {"n_splits": 21}, {"gap": 31}, {"gap": 14}, {"horizon": 91}, {"min_train_size": 6}, {"strategy": "x"}):
        with pytest.raises(ValueError):
            bt.SplitConfig(**bad)


def test_fit_table_roundtrip(spark, tmp_path):
    state, _ = fc.fit(series(spark, range(20)), DAY0, DAY0 + dt.timedelta(days=19), fc.MOVING)
    sinks.write_fit_table(state, str(tmp_path / "fits"))
    back = sinks.read_fit_table(spark, str(tmp_path / "fits"), "moving_average").collect()
    assert back[0].last_values == [float(v) for v in range(13, 20)] and len(back[0].bundle_hash) == 16
    assert sinks.read_fit_table(spark, str(tmp_path / "fits"), "naive").count() == 0


def test_custom_forecaster(spark):
    class Last(fc.Forecaster):
        def fit(self, y):
            self.y = y[-1]
            return self

        def predict(self, horizon):
            return np.full(horizon, self.y)

    fc.register_forecaster("last", Last)
    both = series(spark, [1, 2, 3]).unionByName(series(spark, [7, 8], product=2))
    out = fc.forecast_custom(both, "last", DAY0, DAY0 + dt.timedelta(days=5), 2, KEY)
    assert {(r.product_id, r.step): r.forecast for r in out.collect()} == {(1, 1): 3, (1, 2): 3, (2, 1): 8, (2, 2): 8}


# -- splits --------------------------------------------------------------------------


def folds_by_hand(n, cfg):
    m, g, h, k = cfg.min_train_size, cfg.gap, cfg.horizon, cfg.n_splits
    if n < m + g + h:
        return []
    if n < m + g + k * h:
        k = min(k, max(1, (n - m - g) // h))
    step = max(1, (n - m - g - h) // (k - 1)) if k > 1 else h
    out = []
    for f in range(k):
        start = 0 if cfg.strategy == "expanding" else f * step
        end = m + f * step
        if end + g + h > n:
            break
        out.append((f, start, end, end + g, end + g + h))
    return out


CONFIGS = [
    bt.SplitConfig(),
    bt.SplitConfig(strategy="sliding"),
    bt.SplitConfig(n_splits=3, gap=7),
    bt.SplitConfig(strategy="sliding", n_splits=20, min_train_size=7, gap=2, horizon=3),
    bt.SplitConfig(n_splits=20, min_train_size=20, horizon=30),
]


@pytest.mark.parametrize("cfg", CONFIGS)
@pytest.mark.parametrize("n", [12, 44, 51, 84, 120])
def test_split_positions(spark, cfg, n):
    got = bt.split_boundaries(series(spark, range(n)), cfg, KEY).orderBy("fold").collect()
    assert [(r.fold, r.train_start_idx, r.train_end_idx, r.test_start_idx, r.test_end_idx) for r in got] == folds_by_hand(n, cfg)
    for r in got:
        assert r.train_start == DAY0 + dt.timedelta(days=r.train_start_idx)
        assert r.train_end == DAY0 + dt.timedelta(days=r.train_end_idx - 1)
        assert r.test_end == DAY0 + dt.timedelta(days=r.test_end_idx - 1)


def test_membership_and_leakage(spark):
    cfg = bt.SplitConfig(n_splits=3, gap=7)
    s = series(spark, range(120))
    rows = bt.fold_membership(s, cfg, KEY)
    for f, start, end, test, stop in folds_by_hand(120, cfg):
        roles = {r.row_index: r.role for r in rows.where(F.col("fold") == f).collect()}
        assert roles == {i: "train" if i < end else "gap" if i < test else "test" for i in range(start, stop)}
    check = bt.leakage_check(bt.split_boundaries(s, cfg, KEY), cfg, KEY).first()
    assert check.passed and check.folds == 3
    broken = bt.split_boundaries(s, cfg, KEY).withColumn("test_start_idx", F.col("test_start_idx") - 7)
    assert not bt.leakage_check(broken, cfg, KEY).first().passed


def test_too_short_series(spark):
    assert bt.too_short(series(spark, range(43)), bt.SplitConfig(), KEY).first().needed == 44
    assert bt.split_boundaries(series(spark, range(43)), bt.SplitConfig(), KEY).count() == 0


@pytest.mark.parametrize("cfg", CONFIGS)
def test_backtest_equals_a_loop(spark, cfg):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 9, 130).astype(float)
    got = {(r.model, r.fold, r.step): (r.actual, r.prediction)
           for r in bt.backtest(series(spark, y), (fc.NAIVE, fc.SEASONAL, fc.MOVING), cfg, KEY).collect()}
    want = {}
    for f, start, end, test, stop in folds_by_hand(len(y), cfg):
        train = y[start:end]
        for j in range(stop - test):
            want["naive", f, j] = (y[test + j], train[-1])
            want["seasonal_naive", f, j] = (y[test + j], train[-7:][j % 7])
            want["moving_average", f, j] = (y[test + j], train[-7:].mean())
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_no_leakage_into_predictions(spark):
    y = list(range(1, 121))
    cfg = bt.SplitConfig()
    first = folds_by_hand(120, cfg)[0]
    changed = [v if i < first[2] else v * 100 for i, v in enumerate(y)]
    pick = lambda vs: [r.prediction for r in bt.backtest(series(spark, vs), (fc.MOVING,), cfg, KEY).where("fold = 0").orderBy("step").collect()]
    assert pick(y) == pick(changed)


def test_only_baselines_may_be_skipped(spark):
    long = fc.ModelConfig(model_type="seasonal_naive", season_length=50)
    with pytest.raises(ValueError, match="seasonal_naive"):
        bt.backtest(series(spark, range(120)), (fc.NAIVE, long), bt.SplitConfig(), KEY)
    out = bt.backtest(series(spark, range(120)), (fc.NAIVE, long), bt.SplitConfig(), KEY, baselines=("seasonal_naive",))
    assert {r.model for r in out.select("model").distinct().collect()} == {"naive"}


def test_configs_of_one_type_are_told_apart(spark):
    seven, ten = (fc.ModelConfig(model_type="moving_average", window_size=n) for n in (7, 10))
    out = bt.backtest(series(spark, range(120)), (seven, ten, fc.NAIVE), bt.SplitConfig(), KEY)
    names = {f"moving_average-{m.config_hash()[:8]}": m.window_size for m in (seven, ten)}
    got = {r.model: r.p for r in out.where("fold = 0 and step = 0").select("model", F.col("prediction").alias("p")).collect()}
    last = got.pop("naive")
    assert got == {name: last - (n - 1) / 2 for name, n in names.items()}
    with pytest.raises(ValueError):
        bt.backtest(series(spark, range(120)), (seven, seven), bt.SplitConfig(), KEY)


# -- measures -----------------------------------------------------------------------


def measure(spark, actual, predicted_):
    df = spark.createDataFrame(list(zip(map(float, actual), map(float, predicted_))), "a double, p double")
    return df.agg(*M.fold_metrics(F.col("a"), F.col("p"))).first()


def test_known_measures(spark):
    r = measure(spark, [10, 20, 30], [12, 18, 33])
    assert r.mae == pytest.approx(7 / 3) and r.n_samples == 3
    assert r.bias == pytest.approx(-1.0) and r.wape == pytest.approx(7 / 60 * 100)
    assert r.smape == pytest.approx(100 / 3 * (4 / 22 + 4 / 38 + 6 / 63))
    assert measure(spark, [10, 20], [15, 15]).mae == 5


def test_zero_rules(spark):
    r = measure(spark, [0, 0], [0, 5])
    assert r.smape == 100.0 and r.zero_samples == 2 and r.wape == math.inf and r.zero_actuals
    assert measure(spark, [10, 11, 12], [1, 2, 4]).systematic_bias
    assert not measure(spark, [10, 10], [5, 5]).systematic_bias  # no spread, no warning


def folds(spark, values):
    return spark.createDataFrame([(1, "naive", i, float(v), 1.0, float(v), float(v)) for i, v in enumerate(values)],
                                 "store_id int, model string, fold int, mae double, smape double, wape double, bias double")


def test_stability(spark):
    got = {r.metric: r for r in bt.aggregate_folds(folds(spark, [1, 2, 3]), ["store_id"]).collect()}
    assert got["mae"].value == 2 and got["mae"].stability == pytest.approx(np.std([1, 2, 3]) / 2 * 100)
    assert not got["mae"].unstable and got["smape"].stability == 0
    one = {r.metric: r for r in bt.aggregate_folds(folds(spark, [1]), ["store_id"]).collect()}
    assert math.isnan(one["mae"].stability) and not one["mae"].unstable
    zero = {r.metric: r for r in bt.aggregate_folds(folds(spark, [-1, 1]), ["store_id"]).collect()}
    assert zero["mae"].stability == math.inf and zero["mae"].unstable
    nan = {r.metric: r for r in bt.aggregate_folds(folds(spark, [2, float("nan"), 4]), ["store_id"]).collect()}
    assert nan["mae"].value == 3


def aggregated(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "store_id int, model string, metric string, value double")


def test_baseline_improvement(spark):
    rows = [("main", "mae", 4.0), ("naive", "mae", 5.0), ("seasonal_naive", "mae", 0.0),
            ("main", "bias", -1.0), ("naive", "bias", 2.0), ("seasonal_naive", "bias", float("nan"))]
    got = {r.metric: r for r in bt.compare_baselines(aggregated(spark, rows), "main", ["store_id"]).collect()}
    assert got["mae"].vs_naive_pct == pytest.approx(20) and got["mae"].vs_seasonal_naive_pct is None
    assert got["bias"].vs_naive_pct == pytest.approx(50) and got["bias"].vs_seasonal_naive_pct is None


def test_result_comparison(spark):
    a = aggregated(spark, [("x", "mae", 2.0), ("x", "bias", 0.0), ("x", "only_a", 1.0)]).drop("model")
    b = aggregated(spark, [("y", "mae", 2.0), ("y", "bias", 1.0)]).drop("model")
    got = {r.metric: r for r in bt.compare_results(a, b, ["store_id"]).collect()}
    assert got["mae"].better_model == "a" and got["mae"].verdict == "tie" and got["mae"].difference == 0
    assert got["bias"].percent_change is None and got["only_a"].better_model is None


def test_series_readers(spark):
    sales = spark.createDataFrame([(DAY0, 1, 1, 2, 5.0, 10.0), (DAY0, 1, 2, 0, 5.0, 0.0), (DAY0 + dt.timedelta(days=1), 2, 1, 1, 3.0, 3.0)],
                                  "date date, store_id int, product_id int, quantity int, unit_price double, total_amount double")
    wanted = spark.createDataFrame([(1, 1), (1, 1)], "store_id int, product_id int")
    assert load_series(sales, DAY0, DAY0, wanted).count() == 1
    day = {(r.store_id, r.date): r for r in daily_series(sales, ("store_id",)).collect()}
    assert day[1, DAY0].quantity == 2 and day[1, DAY0].unit_price == 5.0


def test_results_are_json_per_backtest(spark, tmp_path):
    df = spark.createDataFrame([("b1", 1.5), ("b2", 2.5)], "backtest_id string, mae double")
    sinks.write_results(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["backtest_id=b1", "backtest_id=b2"]
    assert spark.read.json(str(tmp_path / "out")).count() == 2

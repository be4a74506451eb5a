"""Registered queries: forecasts and backtests over region x brand series."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from shelfline.operators import backtest as bt
from shelfline.operators import forecast as fc
from shelfline.operators.scale import new_path
from shelfline.plans.common import r, rounded
from shelfline.plans.features import BRAND, brand_daily
from shelfline.plans.views import with_views
from shelfline.sources import sinks

TRAIN_START, TRAIN_END = dt.date(1996, 1, 1), dt.date(2000, 6, 30)
MODELS = (fc.NAIVE, fc.SEASONAL, fc.MOVING)
HORIZON = 14
EXPANDING = bt.SplitConfig()
SLIDING = bt.SplitConfig(strategy="sliding", n_splits=3, gap=7)
# needs 660 rows for twenty folds: shorter series fall back to fewer, overlapping folds
CROWDED = bt.SplitConfig(n_splits=20, min_train_size=60, horizon=30)


def forecasts(model):
    def run(spark, folder):
        state, _ = fc.fit(brand_daily(spark, folder), TRAIN_START, TRAIN_END, model, BRAND)
        out = fc.forecast(state, model, HORIZON, BRAND)
        return rounded(out.select(*BRAND, "model_type", "step", "date", "forecast", "lower", "upper"), "forecast")

    return run


def fitted(spark, folder):
    state, _ = fc.fit(brand_daily(spark, folder), TRAIN_START, TRAIN_END, fc.SEASONAL, BRAND)
    return state.select(
        *BRAND, "model_type", "train_start", "train_end", "n_obs",
        F.array_join(F.transform("last_values", lambda v: v.cast("long").cast("string")), ",").alias("last_values"),
    )


def rejected(spark, folder):
    """A window of 500 rows is too long for most series."""
    model = fc.ModelConfig(model_type="moving_average", window_size=500)
    _, short = fc.fit(brand_daily(spark, folder), dt.date(1995, 1, 1), dt.date(2001, 12, 31), model, BRAND)
    return short


def fit_table_roundtrip(spark, folder):
    """States written as parquet and read back by model."""
    state, _ = fc.fit(brand_daily(spark, folder), TRAIN_START, TRAIN_END, fc.MOVING, BRAND)
    path = new_path(spark, "fits")
    sinks.write_fit_table(state, path)
    back = sinks.read_fit_table(spark, path, "moving_average")
    return rounded(fc.forecast(back, fc.MOVING, 1, BRAND).select(*BRAND, "date", "forecast"), "forecast")


class MedianForecaster(fc.Forecaster):
    """Median of the last 28 values, as an example of an own model."""

    def fit(self, y):
        self.level = float(np.median(y[-28:]))
        return self

    def predict(self, horizon):
        return np.full(horizon, self.level)


fc.register_forecaster("median_28", MedianForecaster)


def custom_forecast(spark, folder):
    return fc.forecast_custom(brand_daily(spark, folder), "median_28", TRAIN_START, TRAIN_END, 7, BRAND)


def boundaries(cfg):
    def run(spark, folder):
        return bt.split_boundaries(brand_daily(spark, folder), cfg, BRAND).select(
            *BRAND, "fold", "train_start", "train_end", "test_start", "test_end", "train_size", "test_size"
        )

    return run


def membership(spark, folder):
    """Rows per fold and role."""
    rows = bt.fold_membership(brand_daily(spark, folder), SLIDING, BRAND)
    return rows.groupBy(*BRAND, "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def leakage(spark, folder):
    edges = bt.split_boundaries(brand_daily(spark, folder), SLIDING, BRAND)
    return bt.leakage_check(edges, SLIDING, BRAND)


def short_series(spark, folder):
    cfg = bt.SplitConfig(min_train_size=500)
    return bt.too_short(brand_daily(spark, folder), cfg, BRAND)


def predictions(cfg):
    def run(spark, folder):
        return rounded(bt.backtest(brand_daily(spark, folder), MODELS, cfg, BRAND), "actual", "prediction")

    return run


def _folds(spark, folder, cfg=EXPANDING):
    return bt.fold_metrics(bt.backtest(brand_daily(spark, folder), MODELS, cfg, BRAND), BRAND)


PAIRED = {
    "mean_7": fc.ModelConfig(model_type="moving_average", window_size=7),
    "mean_28": fc.ModelConfig(model_type="moving_average", window_size=28),
    "season_7": fc.ModelConfig(model_type="seasonal_naive", season_length=7),
    "season_14": fc.ModelConfig(model_type="seasonal_naive", season_length=14),
}


def paired_folds(spark, folder):
    """Two windows and two seasons of the same model types, measured side by side."""
    out = bt.fold_metrics(bt.backtest(brand_daily(spark, folder), PAIRED, EXPANDING, BRAND), BRAND)
    return rounded(out.select(*BRAND, "model", "fold", "mae", "bias", "n_samples"), "mae", "bias")


def metrics(cfg):
    def run(spark, folder):
        out = _folds(spark, folder, cfg).drop("systematic_bias")
        return rounded(out, "mae", "smape", "wape", "bias")

    return run


def metric_warnings(spark, folder):
    out = _folds(spark, folder)
    return out.groupBy("model").agg(
        F.sum("zero_samples").alias("zero_samples"),
        F.count_if("zero_actuals").alias("zero_folds"),
        F.count_if("systematic_bias").alias("biased_folds"),
    )


def aggregated(spark, folder):
    out = bt.aggregate_folds(_folds(spark, folder), BRAND)
    return rounded(out.drop("unstable"), "value", "stability", digits=3)


def baselines(spark, folder):
    out = bt.compare_baselines(bt.aggregate_folds(_folds(spark, folder), BRAND), "moving_average", BRAND)
    return rounded(out, "main", "naive", "seasonal_naive", "vs_naive_pct", "vs_seasonal_naive_pct", digits=3)


def two_results(spark, folder):
    per_model = bt.aggregate_folds(_folds(spark, folder), BRAND)
    out = bt.compare_results(
        per_model.where("model = 'naive'"), per_model.where("model = 'seasonal_naive'"), BRAND
    )
    return rounded(out, "model_a", "model_b", "difference", "percent_change", digits=3)


def results_roundtrip(spark, folder):
    """Fold results of three runs written as JSON, one folder per backtest, and read back."""
    out = _folds(spark, folder).withColumn("backtest_id", F.concat(F.lit("bt-"), F.col("model")))
    path = new_path(spark, "backtests")
    sinks.write_results(out, path)
    back = spark.read.json(path)
    return rounded(back.select(*BRAND, "model", "fold", "backtest_id", "mae", "n_samples"), "mae")


QUERIES = {
    "forecast_naive": forecasts(fc.NAIVE),
    "forecast_seasonal_naive": forecasts(fc.SEASONAL),
    "forecast_moving_average": forecasts(fc.MOVING),
    "fit_state": fitted,
    "fit_rejected": rejected,
    "fit_table": fit_table_roundtrip,
    "forecast_custom": custom_forecast,
    "split_expanding": boundaries(EXPANDING),
    "split_sliding_gap": boundaries(SLIDING),
    "split_reduced": boundaries(CROWDED),
    "fold_membership": membership,
    "leakage_check": leakage,
    "insufficient_series": short_series,
    "backtest_expanding": predictions(EXPANDING),
    "backtest_sliding_gap": predictions(SLIDING),
    "backtest_reduced": predictions(CROWDED),
    "backtest_two_configs": paired_folds,
    "fold_metrics": metrics(EXPANDING),
    "fold_metrics_sliding_gap": metrics(SLIDING),
    "metric_warnings": metric_warnings,
    "fold_aggregate": aggregated,
    "baseline_comparison": baselines,
    "result_comparison": two_results,
    "write_results": results_roundtrip,
}

# -- SQL twins --------------------------------------------------------------------

_PER = "partition by region, brand"
_IN_TRAIN = f"date between date '{TRAIN_START}' and date '{TRAIN_END}'"
_RANKED = f"""select region, brand, date, cast(quantity as double) as y,
       row_number() over ({_PER} order by date desc) as back, count(*) over ({_PER}) as n
from brand_daily where {_IN_TRAIN}"""


def _forecast_sql(model: fc.ModelConfig) -> str:
    size = model.tail
    if model.model_type == "moving_average":
        value = "m.y"
        source = f"(select region, brand, avg(y) as y from ranked where back <= {size} group by 1, 2) m"
        on = "m.region = k.region and m.brand = k.brand"
    else:
        value, source = "m.y", "ranked m"
        on = "m.region = k.region and m.brand = k.brand and m.back = k.need"
    return with_views(
        "brand_daily",
        f"""select k.region, k.brand, '{model.model_type}' as model_type, k.step, date '{TRAIN_END}' + k.step as date,
       {r(value, 'forecast')}, cast(null as double) as lower, cast(null as double) as upper
from keys k join {source} on {on}""",
        ranked=_RANKED,
        keys=f"""select distinct region, brand, cast(s.step as int) as step, {size} - (s.step - 1) % {size} as need
from ranked cross join (select unnest(range(1, {HORIZON + 1})) as step) s where n >= {size}""",
    )


def _folds_cte(cfg: bt.SplitConfig) -> dict[str, str]:
    m, g, h, k = cfg.min_train_size, cfg.gap, cfg.horizon, cfg.n_splits
    first = "0" if cfg.strategy == "expanding" else "f * step"
    return {
        "idx": f"""select region, brand, date, cast(quantity as double) as y,
       row_number() over ({_PER} order by date) - 1 as i, count(*) over ({_PER}) as n from brand_daily""",
        "counted": f"""select distinct region, brand, n,
       case when n < {m + g + k * h} then least({k}, greatest(1, (n - {m + g}) // {h})) else {k} end as k
from idx where n >= {m + g + h}""",
        "stepped": f"select *, case when k > 1 then greatest(1, (n - {m + g + h}) // (k - 1)) else {h} end as step from counted",
        "folds": f"""select * from (select region, brand, n, f, {first} as ts, {m} + f * step as te
from (select *, unnest(range(0, k)) as f from stepped) t) u where te + {g + h} <= n""",
    }


def _bounds_sql(cfg: bt.SplitConfig) -> str:
    g, h = cfg.gap, cfg.horizon
    day = lambda at, name: f"max(date) filter (i = {at}) as {name}"
    return with_views(
        "brand_daily",
        f"""select region, brand, cast(f as int) as fold, {day('ts', 'train_start')}, {day('te - 1', 'train_end')},
       {day(f'te + {g}', 'test_start')}, {day(f'te + {g + h - 1}', 'test_end')},
       cast(te - ts as int) as train_size, {h} as test_size
from folds join idx using (region, brand) group by region, brand, f, ts, te""",
        **_folds_cte(cfg),
    )


def _predictions_cte(cfg: bt.SplitConfig) -> dict[str, str]:
    g, h = cfg.gap, cfg.horizon
    return _folds_cte(cfg) | {
        "tests": f"""select x.region, x.brand, f, x.date, x.y, cast(x.i - te - {g} as int) as step, te - 1 as ni,
       te - 7 + (x.i - te - {g}) % 7 as si, te
from folds fo join idx x on x.region = fo.region and x.brand = fo.brand and x.i >= te + {g} and x.i < te + {g + h}""",
        "means": """select fo.region, fo.brand, f, avg(x.y) as p
from folds fo join idx x on x.region = fo.region and x.brand = fo.brand and x.i >= te - 7 and x.i < te group by 1, 2, 3""",
        "preds": """
select t.region, t.brand, f, 'naive' as model, step, t.date, t.y as a, x.y as p
from tests t join idx x on x.region = t.region and x.brand = t.brand and x.i = t.ni
union all
select t.region, t.brand, f, 'seasonal_naive', step, t.date, t.y, x.y
from tests t join idx x on x.region = t.region and x.brand = t.brand and x.i = t.si
union all
select t.region, t.brand, t.f, 'moving_average', step, t.date, t.y, m.p
from tests t join means m on m.region = t.region and m.brand = t.brand and m.f = t.f""",
    }


def _predictions_sql(cfg):
    return with_views(
        "brand_daily",
        f"""select region, brand, cast(f as int) as fold, model, step, date, {r('a', 'actual')}, {r('p', 'prediction')}
from preds""",
        **_predictions_cte(cfg),
    )


def _paired_sql():
    cte = {k: v for k, v in _predictions_cte(EXPANDING).items() if k in ("idx", "counted", "stepped", "folds", "tests")}
    means = [
        f"""select t.region, t.brand, t.f, '{name}' as model, t.y as a,
       (select avg(x.y) from idx x where x.region = t.region and x.brand = t.brand and x.i >= te - {w} and x.i < te) as p from tests t"""
        for name, w in (("mean_7", 7), ("mean_28", 28))
    ]
    seasons = [
        f"""select t.region, t.brand, t.f, '{name}', t.y, x.y from tests t
join idx x on x.region = t.region and x.brand = t.brand and x.i = te - {w} + step % {w}"""
        for name, w in (("season_7", 7), ("season_14", 14))
    ]
    return with_views(
        "brand_daily",
        f"""select region, brand, model, cast(f as int) as fold, {r('avg(abs(a - p))', 'mae')}, {r('avg(a - p)', 'bias')},
       count(*) as n_samples from pairs group by 1, 2, 3, 4""",
        **cte,
        pairs=" union all ".join(means + seasons),
    )


def _metrics_cte(cfg):
    return _predictions_cte(cfg) | {
        "per_fold": """
select region, brand, f, model, avg(abs(a - p)) as mae,
       100 * avg(case when abs(a) + abs(p) = 0 then 0 else 2 * abs(a - p) / (abs(a) + abs(p)) end) as smape,
       case when sum(abs(a)) = 0 then 'infinity'::double else 100 * sum(abs(a - p)) / sum(abs(a)) end as wape,
       avg(a - p) as bias, count(*) as n_samples, sum(abs(a)) = 0 as zero_actuals,
       count(*) filter (a = 0 or p = 0) as zero_samples,
       coalesce(stddev_pop(a - p) > 0 and abs(avg(a - p)) > stddev_pop(a - p), false) as systematic
from preds group by 1, 2, 3, 4""",
    }


def _metrics_sql(cfg):
    return with_views(
        "brand_daily",
        f"""select region, brand, cast(f as int) as fold, model, {r('mae', 'mae')}, {r('smape', 'smape')}, {r('wape', 'wape')},
       {r('bias', 'bias')}, n_samples, zero_samples, zero_actuals from per_fold""",
        **_metrics_cte(cfg),
    )


def _aggregate_cte():
    return _metrics_cte(EXPANDING) | {
        "agg": " union all ".join(
            f"""select region, brand, model, count(*) as folds, '{m}' as metric, avg({m}) as value,
       case when count({m}) < 2 then 'nan'::double when avg({m}) = 0 then 'infinity'::double
            else stddev_pop({m}) / abs(avg({m})) * 100 end as stability
from per_fold group by 1, 2, 3"""
            for m in ("mae", "smape", "wape", "bias")
        ),
        "wide": """select region, brand, metric, max(value) filter (model = 'moving_average') as main,
       max(value) filter (model = 'naive') as naive, max(value) filter (model = 'seasonal_naive') as seasonal_naive
from agg group by 1, 2, 3""",
    }


def _gain(base: str) -> str:
    size = lambda c: f"(case when metric = 'bias' then abs({c}) else {c} end)"
    return r(f"({size(base)} - {size('main')}) / nullif({size(base)}, 0) * 100", f"vs_{base}_pct", 3)


ORACLES = {
    **{f"forecast_{m.model_type}": _forecast_sql(m) for m in MODELS},
    "fit_state": with_views(
        "brand_daily",
        f"""select region, brand, 'seasonal_naive' as model_type, date '{TRAIN_START}' as train_start, date '{TRAIN_END}' as train_end,
       max(n) as n_obs, string_agg(cast(cast(y as bigint) as varchar), ',' order by date) as last_values
from ranked where back <= 7 group by 1, 2 having max(n) >= 7""",
        ranked=_RANKED,
    ),
    "fit_rejected": with_views(
        "brand_daily",
        """select region, brand, 'moving_average' as model_type, count(*) as n_obs, 'needs 500 values' as reason
from brand_daily group by 1, 2 having count(*) < 500""",
    ),
    "fit_table": with_views(
        "brand_daily",
        f"""select region, brand, date '{TRAIN_END}' + 1 as date, {r('avg(y)', 'forecast')}
from ranked where back <= 7 group by 1, 2 having max(n) >= 7""",
        ranked=_RANKED,
    ),
    "forecast_custom": with_views(
        "brand_daily",
        f"""select region, brand, 'median_28' as model_type, step, date '{TRAIN_END}' + step as date, m as forecast
from (select region, brand, median(y) as m from ranked where back <= 28 group by 1, 2) t
cross join (select cast(unnest(range(1, 8)) as int) as step) s""",
        ranked=_RANKED,
    ),
    "split_expanding": _bounds_sql(EXPANDING),
    "split_sliding_gap": _bounds_sql(SLIDING),
    "split_reduced": _bounds_sql(CROWDED),
    "fold_membership": with_views(
        "brand_daily",
        f"""select region, brand, cast(f as int) as fold, role, count(*) as rows, min(date) as first_date, max(date) as last_date
from (select x.region, x.brand, f, x.date, case when i < te then 'train' when i < te + {SLIDING.gap} then 'gap' else 'test' end as role
      from folds fo join idx x on x.region = fo.region and x.brand = fo.brand and i >= ts and i < te + {SLIDING.gap + SLIDING.horizon}) t
group by 1, 2, 3, 4""",
        **_folds_cte(SLIDING),
    ),
    "leakage_check": with_views(
        "brand_daily",
        """select region, brand, count(*) as folds, true as in_order, true as gap_kept, true as disjoint, true as passed
from folds group by 1, 2""",
        **_folds_cte(SLIDING),
    ),
    "insufficient_series": with_views(
        "brand_daily",
        "select region, brand, count(*) as n, 514 as needed from brand_daily group by 1, 2 having count(*) < 514",
    ),
    "backtest_expanding": _predictions_sql(EXPANDING),
    "backtest_sliding_gap": _predictions_sql(SLIDING),
    "backtest_reduced": _predictions_sql(CROWDED),
    "backtest_two_configs": _paired_sql(),
    "fold_metrics": _metrics_sql(EXPANDING),
    "fold_metrics_sliding_gap": _metrics_sql(SLIDING),
    "metric_warnings": with_views(
        "brand_daily",
        """select model, cast(sum(zero_samples) as bigint) as zero_samples, count(*) filter (zero_actuals) as zero_folds,
       count(*) filter (systematic) as biased_folds from per_fold group by 1""",
        **_metrics_cte(EXPANDING),
    ),
    "fold_aggregate": with_views(
        "brand_daily",
        f"select region, brand, model, folds, metric, {r('value', 'value', 3)}, {r('stability', 'stability', 3)} from agg",
        **_aggregate_cte(),
    ),
    "baseline_comparison": with_views(
        "brand_daily",
        f"""select region, brand, metric, {r('main', 'main', 3)}, {r('naive', 'naive', 3)}, {r('seasonal_naive', 'seasonal_naive', 3)},
       {_gain('naive')}, {_gain('seasonal_naive')} from wide""",
        **_aggregate_cte(),
    ),
    "result_comparison": with_views(
        "brand_daily",
        f"""select w.region, w.brand, metric, {r('naive', 'model_a', 3)}, {r('seasonal_naive', 'model_b', 3)},
       {r('seasonal_naive - naive', 'difference', 3)},
       {r("case when abs(naive) > 1e-10 then (seasonal_naive - naive) / abs(naive) * 100 end", 'percent_change', 3)},
       case when naive <= seasonal_naive then 'a' else 'b' end as better_model,
       case when ma < mb then 'a' when mb < ma then 'b' else 'tie' end as verdict
from wide w join (select region, brand, naive as ma, seasonal_naive as mb from wide where metric = 'mae') m
  on m.region = w.region and m.brand = w.brand""",
        **_aggregate_cte(),
    ),
    "write_results": with_views(
        "brand_daily",
        f"""select region, brand, model, f as fold, 'bt-' || model as backtest_id, {r('mae', 'mae')}, n_samples from per_fold""",
        **_metrics_cte(EXPANDING),
    ),
}

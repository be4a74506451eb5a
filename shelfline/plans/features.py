"""Registered queries: feature engineering over region and region x brand series."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from shelfline.functions import features
from shelfline.functions.config import (
    AGGREGATIONS,
    CalendarConfig,
    ExogenousConfig,
    FeatureSetConfig,
    ImputationConfig,
    LagConfig,
    RollingConfig,
)
from shelfline.operators.exog import stock_status, with_holidays
from shelfline.operators.scale import HotKeys, salted_join
from shelfline.plans.common import END, START, r, rounded
from shelfline.plans.views import with_views
from shelfline.sources.star import daily_series, load_star

BRAND = ("region", "brand")
CUTOFF = dt.date(2000, 12, 31)


def brand_daily(spark, folder):
    star = load_star(spark, folder)
    stores = star.store.select(F.col("id").alias("store_id"), "region")
    products = star.product.select(F.col("id").alias("product_id"), "brand")
    grain = ["date", "store_id", "product_id"]
    measure = HotKeys(star.sales_daily, "product_id", "store_id")
    named = salted_join(star.sales_daily, products, ["product_id"], spread=grain, measure=measure)
    named = salted_join(named, stores, ["store_id"], spread=grain, measure=measure)
    return daily_series(named, BRAND)


def brand_gaps(spark, folder):
    """Brand series with holes: every fifth quantity and every seventh price is missing."""
    day = F.col("date")
    return brand_daily(spark, folder).select(
        *BRAND,
        "date",
        F.when((F.day(day) + F.month(day)) % 5 != 0, F.col("quantity").cast("double")).alias("quantity"),
        F.when(F.day(day) % 7 != 0, F.col("unit_price")).alias("unit_price"),
    )


def _run(spark, folder, source=brand_daily, **parts):
    config = FeatureSetConfig(entity_columns=BRAND, **parts)
    return features.compute_features(source(spark, folder), config)


def _base(result, *columns):
    """Keys and features, doubles rounded."""
    kinds = dict(result.df.dtypes)
    wanted = [c for c in (*columns, *result.feature_columns)]
    out = result.df.select(*BRAND, "date", *wanted)
    return rounded(out, *[c for c in wanted if kinds[c] == "double" or kinds[c].startswith("decimal")])


def feature_cutoff(spark, folder):
    rows = features.cutoff(brand_daily(spark, folder), CUTOFF, 365)
    return rounded(rows, "unit_price", "total_amount")


def feature_lags(spark, folder):
    return _base(_run(spark, folder, lag_config=LagConfig()))


def feature_lags_filled(spark, folder):
    return _base(_run(spark, folder, lag_config=LagConfig(lags=(1, 30), fill_value=0.0)))


def feature_rolling(spark, folder):
    return _base(_run(spark, folder, rolling_config=RollingConfig(aggregations=AGGREGATIONS)))


def feature_rolling_gaps(spark, folder):
    """Rolling statistics over a target with nulls and a minimum of three values."""
    config = RollingConfig(windows=(7,), aggregations=AGGREGATIONS, min_periods=3)
    return _base(_run(spark, folder, brand_gaps, rolling_config=config))


def feature_calendar(spark, folder):
    return _base(_run(spark, folder, calendar_config=CalendarConfig(include_year=True)))


def feature_calendar_raw(spark, folder):
    config = CalendarConfig(include_year=True, use_cyclical_encoding=False)
    return _base(_run(spark, folder, calendar_config=config))


def feature_price(spark, folder):
    return _base(_run(spark, folder, exogenous_config=ExogenousConfig()))


def feature_stockout(spark, folder):
    """Stockout, stock and promotion signals of store series, each lagged by one row."""
    star = load_star(spark, folder)
    per_day = (
        star.dealt(stock_status(star.sales_daily, star.inventory_snapshot_daily), "store_id", "date")
        .groupBy("store_id", "date")
        .agg(
            F.sum("units_sold").alias("quantity"),
            F.bool_or("is_stockout").alias("is_stockout"),
            F.sum("eod_inventory").alias("on_hand_qty"),
        )
    )
    config = FeatureSetConfig(
        entity_columns=("store_id",), exogenous_config=ExogenousConfig(include_inventory=True)
    )
    # a store has a row a day by now
    result = features.compute_features(star.dealt(per_day, "store_id"), config)
    return result.df.select("store_id", "date", *result.feature_columns)


def feature_holiday(spark, folder):
    """Calendar features with the holiday flag of the calendar table."""
    star = load_star(spark, folder)

    def source(*_):
        return with_holidays(brand_daily(spark, folder), star.calendar)

    return _base(_run(spark, folder, source, calendar_config=CalendarConfig()))


def impute(strategy):
    def run(spark, folder):
        config = ImputationConfig(strategies={"quantity": strategy, "unit_price": strategy})
        out = features.impute(brand_gaps(spark, folder), config, BRAND)
        return rounded(out, "quantity", "unit_price")

    return run


FULL = FeatureSetConfig(
    name="full",
    entity_columns=BRAND,
    lag_config=LagConfig(),
    rolling_config=RollingConfig(),
    calendar_config=CalendarConfig(),
    exogenous_config=ExogenousConfig(),
    imputation_config=ImputationConfig(),
)


def feature_set(spark, folder):
    return _base(features.compute_features(brand_gaps(spark, folder), FULL), "quantity", "unit_price")


def feature_set_blocked(spark, folder):
    """The same features with every series cut into blocks of 100 rows."""
    result = features.compute_features(brand_gaps(spark, folder), FULL, block_rows=100)
    return _base(result, "quantity", "unit_price")


def feature_null_counts(spark, folder):
    return features.compute_features(brand_gaps(spark, folder), FULL).null_counts()


def feature_preview(spark, folder):
    config = FeatureSetConfig(entity_columns=BRAND, lag_config=LagConfig(lags=(1, 7)))
    out = features.preview(brand_daily(spark, folder), config, CUTOFF, 5)
    return out.select(*BRAND, "date", "quantity", "lag_1", "lag_7")


def sql_lags(spark, folder):
    return features.daily_lags(brand_daily(spark, folder), BRAND, START, END)


def sql_moving_average(spark, folder):
    return features.moving_average(brand_daily(spark, folder), BRAND, START, END)


QUERIES = {
    "feature_cutoff": feature_cutoff,
    "feature_lags": feature_lags,
    "feature_lags_filled": feature_lags_filled,
    "feature_rolling": feature_rolling,
    "feature_rolling_gaps": feature_rolling_gaps,
    "feature_calendar": feature_calendar,
    "feature_calendar_raw": feature_calendar_raw,
    "feature_holiday": feature_holiday,
    "feature_price": feature_price,
    "feature_stockout": feature_stockout,
    **{f"impute_{s}": impute(s) for s in ("zero", "ffill", "bfill", "mean", "expanding_mean", "drop")},
    "feature_set": feature_set,
    "feature_set_blocked": feature_set_blocked,
    "feature_null_counts": feature_null_counts,
    "feature_preview": feature_preview,
    "sql_lags": sql_lags,
    "sql_moving_average": sql_moving_average,
}

_UNTIL = f"date <= date '{CUTOFF}'"
_W = "window w as (partition by region, brand order by date)"
_SQL_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}


def _lags(lags, column="quantity", prefix="lag", fill=None):
    one = "lag({c}, {k}) over w"
    if fill is not None:
        one = f"coalesce({one}, {fill})"
    return ", ".join(f"{one.format(c=column, k=k)} as {prefix}_{k}" for k in lags)


def _rolled(n, names, needed):
    frame = f"over (partition by region, brand order by date rows between {n} preceding and 1 preceding)"
    parts = []
    for name in names:
        parts.append(
            (name, n, f"case when count(quantity) {frame} >= {needed} then cast({_SQL_AGG[name]}(quantity) {frame} as KIND) end")
        )
    return parts


def _rolling(windows, names, needed=None, whole=False):
    out = []
    for n in windows:
        for name, size, sql in _rolled(n, names, needed or n):
            integer = whole and name in ("min", "max", "sum")
            sql = sql.replace("KIND", "bigint" if integer else "double")
            out.append(f"{sql} as rolling_{name}_{size}" if integer else r(sql, f"rolling_{name}_{size}"))
    return ", ".join(out)


def _cycle(cyclic):
    if not cyclic:
        return "cast(isodow(date) - 1 as int) as day_of_week, cast(month(date) as int) as month"
    return ", ".join(
        r(f"{f}({value} * {2 * math.pi / length!r})", f"{name}_{f}")
        for name, value, length in (("dow", "(isodow(date) - 1)", 7), ("month", "month(date)", 12))
        for f in ("sin", "cos")
    )


def _calendar(cyclic=True, year=True):
    return (
        _cycle(cyclic)
        + ", cast(quarter(date) as int) as quarter"
        + (", cast(year(date) as int) as year" if year else "")
        + ", cast(isodow(date) >= 6 as int) as is_weekend, cast(date = last_day(date) as int) as is_month_end"
    )


_PRICE = ", ".join(
    [r(f"lag(unit_price, {k}) over w", f"price_lag_{k}") for k in (7, 28)]
    + [r("lag(unit_price, 1) over w / nullif(lag(unit_price, 8) over w, 0) - 1", "price_pct_change_7d")]
)

_IMPUTE = {
    "zero": "coalesce({c}, 0)",
    "ffill": "last_value({c} ignore nulls) over (partition by region, brand order by date rows between unbounded preceding and current row)",
    "bfill": "first_value({c} ignore nulls) over (partition by region, brand order by date rows between current row and unbounded following)",
    "mean": "coalesce({c}, avg({c}) over (partition by region, brand))",
    "expanding_mean": "coalesce({c}, avg({c}) over (partition by region, brand order by date rows between unbounded preceding and 1 preceding))",
    "drop": "{c}",
}


def _impute_sql(strategy):
    cells = ", ".join(r(_IMPUTE[strategy].format(c=c), c) for c in ("quantity", "unit_price"))
    where = " where quantity is not null and unit_price is not null" if strategy == "drop" else ""
    return with_views("brand_gaps", f"select region, brand, date, {cells} from brand_gaps{where}")


_FULL_PARTS = f"""{r('quantity', 'quantity')}, {r('unit_price', 'unit_price')},
       {', '.join(r(f'lag(quantity, {k}) over w', f'lag_{k}') for k in (1, 7, 14, 28))},
       {_rolling((7, 14, 28), ('mean', 'std'))}, {_calendar(year=False)}, {_PRICE}"""
_FULL_SQL = with_views(
    "brand_gaps",
    f"select region, brand, date, {_FULL_PARTS} from filled {_W}",
    filled=f"""select region, brand, date, coalesce(quantity, 0) as quantity,
       {_IMPUTE['ffill'].format(c='unit_price')} as unit_price from brand_gaps""",
)
_FULL_COLUMNS = (
    ["lag_1", "lag_7", "lag_14", "lag_28"]
    + [f"rolling_{a}_{n}" for n in (7, 14, 28) for a in ("mean", "std")]
    + ["dow_sin", "dow_cos", "month_sin", "month_cos", "quarter", "is_weekend", "is_month_end"]
    + ["price_lag_7", "price_lag_28", "price_pct_change_7d"]
)

ORACLES = {
    "feature_cutoff": with_views(
        "brand_daily",
        f"""select region, brand, date, quantity, {r('unit_price', 'unit_price')}, {r('total_amount', 'total_amount')}
from brand_daily where {_UNTIL} and date >= date '{CUTOFF - dt.timedelta(days=365)}'""",
    ),
    "feature_lags": with_views(
        "brand_daily", f"select region, brand, date, {_lags((1, 7, 14, 28))} from brand_daily {_W}"
    ),
    "feature_lags_filled": with_views(
        "brand_daily",
        f"""select region, brand, date, {', '.join(r(f'coalesce(lag(quantity, {k}) over w, 0)', f'lag_{k}') for k in (1, 30))}
from brand_daily {_W}""",
    ),
    "feature_rolling": with_views(
        "brand_daily",
        f"select region, brand, date, {_rolling((7, 14, 28), AGGREGATIONS, whole=True)} from brand_daily",
    ),
    "feature_rolling_gaps": with_views(
        "brand_gaps", f"select region, brand, date, {_rolling((7,), AGGREGATIONS, 3)} from brand_gaps"
    ),
    "feature_calendar": with_views(
        "brand_daily", f"select region, brand, date, {_calendar()} from brand_daily"
    ),
    "feature_calendar_raw": with_views(
        "brand_daily", f"select region, brand, date, {_calendar(False)} from brand_daily"
    ),
    "feature_holiday": with_views(
        "brand_daily calendar",
        f"""select region, brand, date, {_calendar(year=False)}, cast(coalesce(is_holiday, false) as int) as is_holiday
from brand_daily left join (select date, is_holiday from calendar) c using (date)""",
    ),
    "feature_price": with_views(
        "brand_daily", f"select region, brand, date, {_PRICE} from brand_daily {_W}"
    ),
    "feature_stockout": with_views(
        "inventory_snapshot_daily",
        f"""select store_id, date, lag(is_stockout, 1) over w as stockout_lag_1, cast(lag(on_hand, 1) over w as bigint) as on_hand_lag_1
from (select store_id, date, bool_or(is_stockout) as is_stockout, sum(on_hand_qty) as on_hand
      from inventory_snapshot_daily group by 1, 2) t window w as (partition by store_id order by date)""",
    ),
    **{f"impute_{s}": _impute_sql(s) for s in _IMPUTE},
    "feature_set": _FULL_SQL,
    "feature_set_blocked": _FULL_SQL,
    "feature_null_counts": with_views(
        "brand_gaps",
        " union all ".join(
            f"select '{c}' as feature, count(*) - count({c}) as nulls, (select count(*) from brand_gaps) as input_rows, "
            f"count(*) as output_rows, {len(_FULL_COLUMNS)} as feature_count from feats"
            for c in _FULL_COLUMNS
        ),
        filled=f"""select region, brand, date, coalesce(quantity, 0) as quantity,
       {_IMPUTE['ffill'].format(c='unit_price')} as unit_price from brand_gaps""",
        feats=f"select region, brand, date, {_FULL_PARTS} from filled {_W}",
    ),
    "feature_preview": with_views(
        "brand_daily",
        f"""select region, brand, date, quantity, lag_1, lag_7 from (
select *, {_lags((1, 7))}, row_number() over (partition by region, brand order by date desc) as rn
from brand_daily where {_UNTIL} and date >= date '{CUTOFF - dt.timedelta(days=365)}' {_W}) t where rn <= 5""",
    ),
    "sql_lags": with_views(
        "brand_daily",
        f"""select region, brand, date, quantity, l1 as quantity_lag_1d, l7 as quantity_lag_7d from (
select *, lag(quantity, 1) over w as l1, lag(quantity, 7) over w as l7 from brand_daily {_W}) t
where date between date '{START}' and date '{END}' and l7 is not null""",
    ),
    "sql_moving_average": with_views(
        "brand_daily",
        f"""select region, brand, date, quantity, round(ma, 2) as quantity_ma_7d, round(sd, 2) as quantity_std_7d from (
select *, avg(quantity) over f as ma, stddev_samp(quantity) over f as sd from brand_daily
window f as (partition by region, brand order by date rows between 7 preceding and 1 preceding)) t
where date between date '{START}' and date '{END}'""",
    ),
}

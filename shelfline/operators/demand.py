"""Calendar dimension, price and promotion expansion, expected demand and sparsity."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.operators.exog import GRAIN, active_promotions
from shelfline.operators.scale import HotKeys, kept, salted_join

# fixed values: (month, day) -> name
FIXED_HOLIDAYS = {
    (1, 1): "New Year's Day",
    (6, 19): "Juneteenth",
    (7, 4): "Independence Day",
    (11, 11): "Veterans Day",
    (12, 25): "Christmas Day",
}
# fixed values: name -> month, weekday (0 = Monday), occurrence (0 = last of the month)
MOVING_HOLIDAYS = {
    "Martin Luther King Jr. Day": (1, 0, 3),
    "Presidents Day": (2, 0, 3),
    "Memorial Day": (5, 0, 0),
    "Labor Day": (9, 0, 1),
    "Columbus Day": (10, 0, 2),
    "Thanksgiving": (11, 3, 4),
}


def holiday_name(day: Column) -> Column:
    """US holiday of a day, NULL on other days; each rule looks at the day alone."""
    of_month = F.day(day)
    rules = []
    for name, (month, weekday, nth) in MOVING_HOLIDAYS.items():
        if nth:
            place = of_month.between(7 * nth - 6, 7 * nth)
        else:
            place = of_month > F.day(F.last_day(day)) - 7
        rules.append(F.when((F.month(day) == month) & (F.weekday(day) == weekday) & place, name))
    for (month, dom), name in FIXED_HOLIDAYS.items():
        rules.append(F.when((F.month(day) == month) & (of_month == dom), name))
    return F.coalesce(*rules)


def calendar_dimension(span: DataFrame, custom: dict[dt.date, str] | None = None) -> DataFrame:
    """One row per day between the smallest ``first`` and the largest ``last`` of ``span``.

    ``custom`` names override the US holidays.
    """
    day = F.col("date")
    name = holiday_name(day)
    if custom:
        name = F.coalesce(*[F.when(day == F.lit(d), n) for d, n in custom.items()], name)
    return (
        span.agg(F.min("first").alias("_a"), F.max("last").alias("_b"))
        .where(F.col("_a").isNotNull())
        .select(F.explode(F.sequence("_a", "_b")).alias("date"))
        .select(
            day,
            F.weekday(day).alias("day_of_week"),
            F.month(day).alias("month"),
            F.quarter(day).alias("quarter"),
            F.year(day).alias("year"),
            name.alias("holiday_name"),
        )
        .withColumn("is_holiday", F.col("holiday_name").isNotNull())
    )


def price_windows(events: DataFrame, keys: Sequence[str] = ("product_id", "store_id")) -> DataFrame:
    """Validity windows from change events (keys, price, valid_from): each ends the day before the next.

    Events of one key lie on different days, so a window partition is bounded by the calendar.
    """
    following = F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from"))
    return events.select(*keys, "price", "valid_from", F.date_sub(following, 1).alias("valid_to"))


def disjoint_windows(promotions: DataFrame) -> DataFrame:
    """The promotions of each (product, store), cut to the days that none of those before has; a NULL store is one of its own.

    What is dealt and sorted are windows; their days are only made of the result, each of them once.
    """
    dated = promotions.where(F.col("start_date") <= F.col("end_date")).select("product_id", "store_id", "start_date", "end_date")
    earlier = Window.partitionBy("product_id", "store_id").orderBy("start_date", "end_date").rowsBetween(Window.unboundedPreceding, -1)
    first = F.greatest("start_date", F.date_add(F.max("end_date").over(earlier), 1))  # the first window has none before it
    return dated.withColumn("start_date", first).where(F.col("start_date") <= F.col("end_date"))


def _days_of(windows: DataFrame) -> DataFrame:
    return windows.select("product_id", "store_id", F.explode(F.sequence("start_date", "end_date")).alias("date"))


def promotion_days(promotions: DataFrame) -> DataFrame:
    """Distinct (product, store, day) on promotion; a NULL store stands for every store."""
    return _days_of(disjoint_windows(promotions))


def promotion_store_days(promotions: DataFrame, assortment: DataFrame) -> DataFrame:
    """``promotion_days`` with NULL stores replaced by every store that carries the product.

    ``assortment`` has one row per (store_id, product_id).  The windows of every store are merged for each product before
    stores are attached, and with a store's own ones after it; both are shuffled as windows, not as days.
    No store meets a product it does not carry.
    """
    chain = disjoint_windows(promotions.where(F.col("store_id").isNull())).drop("store_id")
    carried = assortment.select("store_id", "product_id").distinct()
    everywhere = salted_join(carried, chain, ["product_id"], spread=["store_id"])
    own = promotions.where(F.col("store_id").isNotNull()).select(*everywhere.columns)
    return _days_of(disjoint_windows(everywhere.unionByName(own)))


# -- expected demand ------------------------------------------------------------------

#: What the units of a day are compared by.
SIGNALS = ("day_of_week", "is_holiday", "on_promotion")


def signalled_sales(sales: DataFrame, promotions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sales by grain with weekday, holiday and promotion of the day; days that the calendar lacks are no holidays."""
    days = calendar.select("date", "is_holiday")
    flagged = active_promotions(sales, promotions).groupBy(*GRAIN).agg(
        F.first("quantity").alias("quantity"), F.bool_or("on_promotion").alias("on_promotion")
    )
    named = salted_join(flagged, days, ["date"], "left", measure=HotKeys(sales, "date"))
    return named.select(*GRAIN, "quantity", F.weekday("date").alias("day_of_week"), F.coalesce("is_holiday", F.lit(False)).alias("is_holiday"), "on_promotion")


def demand_factors(leveled: DataFrame) -> DataFrame:
    """``multiplier`` of each combination of the signals, counted from rows with ``quantity`` and ``level``.

    The factor of a signal's value is the units sold on its rows, over the units that their levels add up to; a
    combination takes the product of its factors.  There are at most 28 combinations.
    """
    cells = leveled.groupBy(*SIGNALS).agg(F.sum(F.col("quantity").cast("double")).alias("sold"), F.sum("level").alias("normal"))
    multiplier = F.lit(1.0)
    for signal in SIGNALS:
        rows = Window.partitionBy(signal)
        multiplier = multiplier * F.coalesce(F.try_divide(F.sum("sold").over(rows), F.sum("normal").over(rows)), F.lit(1.0))
    return cells.select(*SIGNALS, multiplier.alias("multiplier"))


def expected_demand(sales: DataFrame, promotions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each sale with the units to be expected: the mean of its product, times what weekday, holiday and promotion were
    seen to change.

    Levels, factors and result read the sales with their signals, which are written before: the match with the
    promotions is made once.
    """
    rows = kept(signalled_sales(sales, promotions, calendar), "signalled-sales")
    # summed before the join: a row per product and task
    levels = rows.groupBy("product_id").agg(F.avg("quantity").alias("level"))
    leveled = salted_join(rows, levels, ["product_id"], spread=GRAIN, measure=HotKeys(rows, "product_id"))
    named = demand_factors(leveled).withColumnsRenamed({s: f"_{s}" for s in SIGNALS})
    same = F.lit(True)
    for signal in SIGNALS:
        same = same & (F.col(signal) == F.col(f"_{signal}"))
    return leveled.join(F.broadcast(named), same).select(*GRAIN, "quantity", (F.col("level") * F.col("multiplier")).alias("expected_demand"))


# -- sparsity --------------------------------------------------------------------------


def missing_share(sales: DataFrame, store: DataFrame, product: DataFrame) -> DataFrame:
    """How many of all store x product combinations never sell."""
    pairs = sales.groupBy("store_id", "product_id").agg(F.count(F.lit(1)).alias("_n"))
    stores = store.agg(F.count(F.lit(1))).scalar()
    products = product.agg(F.count(F.lit(1))).scalar()
    return pairs.agg(F.count(F.lit(1)).alias("active_pairs")).withColumn(
        "possible_pairs", stores * products
    ).withColumn(
        "missing_share", 1 - F.try_divide(F.col("active_pairs").cast("double"), F.col("possible_pairs"))
    )


def gaps(series: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Runs of missing days inside each series: first missing day and length.

    ``series`` is daily, so a window partition is bounded by the calendar.
    """
    before = F.lag("date").over(Window.partitionBy(*entity).orderBy("date"))
    return (
        series.select(*entity, "date", before.alias("_before"))
        .where(F.datediff("date", "_before") > 1)
        .select(
            *entity,
            F.date_add("_before", 1).alias("gap_start"),
            (F.datediff("date", "_before") - 1).alias("gap_days"),
        )
    )

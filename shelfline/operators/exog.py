"""Joins of daily sales with prices, promotions, stock and dimensions.

Validity intervals are inclusive on both ends and a NULL store means "every store".  The product
key stays an equality: these are hash joins with the date test as residual condition, or sweeps in date order for
many windows, never nested loops over the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.operators.filters import discount_pct, stock_bucket
from shelfline.operators.scale import HotKeys, fits_broadcast, salted_join
from shelfline.operators.sweep import sweep_join

GRAIN = ["date", "store_id", "product_id"]
#: Unknown keys that are sent to the rows rather than joined with them.
FEW_KEYS = 10_000


def interval_join(
    sales: DataFrame,
    windows: DataFrame,
    first: str,
    last: str,
    how: str = "left",
    measure: HotKeys | None = None,
) -> DataFrame:
    """Sales rows with the windows of their product that cover their date and store.

    ``windows`` has product_id, store_id (NULL = every store), ``first``, ``last`` (NULL = open) and
    payload columns.  Every match counts: several windows over one sale give several rows.

    A small ``windows`` side is broadcast by the optimizer.  A large one is swept, see ``sweep``: a long history
    of one product does not meet all its sales, and products that hold a large share of the sales are cut by
    days.  ``measure``: see ``salted_join``.
    """
    side = windows.withColumnRenamed("store_id", "_w_store")
    drop = ["_w_store"] if how in ("inner", "left") else []
    if fits_broadcast(windows):
        covers = (
            (F.col("_w_store").isNull() | (F.col("_w_store") == F.col("store_id")))
            & (F.col("date") >= F.col(first))
            & (F.col(last).isNull() | (F.col("date") <= F.col(last)))
        )
        return salted_join(sales, side, ["product_id"], how, covers).drop(*drop)
    return sweep_join(sales, side, "product_id", "date", "store_id", "_w_store", first, last, how, measure).drop(*drop)


def active_price(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """Sales with each list price valid on the day, and the discount against it."""
    windows = prices.select("product_id", "store_id", "price", "valid_from", "valid_to")
    return interval_join(sales, windows, "valid_from", "valid_to").select(
        *GRAIN,
        "quantity",
        F.col("unit_price").alias("sale_price"),
        F.col("price").alias("list_price"),
        discount_pct(F.col("price"), F.col("unit_price")).alias("discount_pct"),
    )


def best_price(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """As ``active_price`` with one row per sale: a store's own price first, then the latest start."""
    windows = prices.select(
        "product_id",
        "store_id",
        F.col("store_id").isNotNull().alias("own"),
        "price",
        "valid_from",
        "valid_to",
    )
    matched = interval_join(sales, windows, "valid_from", "valid_to")
    order = F.struct("own", "valid_from", "price")
    # an aggregate, not a row_number window: candidates of a sale shrink before the shuffle
    best = matched.groupBy(*GRAIN).agg(
        F.first("quantity").alias("quantity"),
        F.first("unit_price").alias("sale_price"),
        F.max(F.when(F.col("price").isNotNull(), order)).alias("best"),
    )
    price = F.col("best.price")
    return best.select(
        *GRAIN,
        "quantity",
        "sale_price",
        price.alias("list_price"),
        discount_pct(price, F.col("sale_price")).alias("discount_pct"),
    )


def _promo_windows(promotions: DataFrame) -> DataFrame:
    return promotions.select(
        F.col("id").alias("promo_id"),
        "product_id",
        "store_id",
        F.col("name").alias("promo_name"),
        F.col("discount_pct").alias("promo_discount_pct"),
        F.col("discount_amount").alias("promo_discount_amount"),
        "start_date",
        "end_date",
    )


def active_promotions(sales: DataFrame, promotions: DataFrame, how: str = "left") -> DataFrame:
    """Sales with each promotion running on the day, and an ``on_promotion`` flag."""
    joined = interval_join(sales, _promo_windows(promotions), "start_date", "end_date", how)
    return joined.withColumn("on_promotion", F.col("promo_id").isNotNull())


def without_promotion(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Sales rows on which no promotion runs."""
    windows = promotions.select("product_id", "store_id", "start_date", "end_date")
    return interval_join(sales, windows, "start_date", "end_date", "left_anti")


def stock_status(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Sales with end-of-day stock and its bucket; both sides have one row per grain."""
    stock = inventory.select(*GRAIN, "on_hand_qty", "is_stockout")
    return sales.join(stock, GRAIN, "left").select(
        *GRAIN,
        F.col("quantity").alias("units_sold"),
        F.col("on_hand_qty").alias("eod_inventory"),
        "is_stockout",
        stock_bucket(F.col("on_hand_qty"), F.col("quantity")).alias("inventory_status"),
    )


def exogenous_set(
    sales: DataFrame,
    store: DataFrame,
    product: DataFrame,
    calendar: DataFrame,
    prices: DataFrame,
    promotions: DataFrame,
    inventory: DataFrame,
) -> DataFrame:
    """The full exogenous feature table: dimensions, list price, promotion and stock signals.

    The stock join comes first, while the sales still have the partitioning of their grain.
    """
    stock = inventory.select(*GRAIN, "on_hand_qty", "is_stockout")
    measure = HotKeys(sales, "product_id", "store_id", "date")
    facts = sales.join(stock, GRAIN, "left")
    facts = interval_join(
        facts,
        prices.select("product_id", "store_id", F.col("price").alias("list_price"), "valid_from", "valid_to"),
        "valid_from",
        "valid_to",
        measure=measure,
    )
    facts = interval_join(facts, _promo_windows(promotions), "start_date", "end_date", measure=measure)
    stores = store.select(
        F.col("id").alias("store_id"), F.col("code").alias("store_code"), "region", "store_type"
    )
    products = product.select(F.col("id").alias("product_id"), "sku", "category", "brand")
    days = calendar.select("date", "day_of_week", "month", "quarter", "is_holiday")
    named = salted_join(facts, stores, ["store_id"], spread=GRAIN, measure=measure)
    named = salted_join(named, products, ["product_id"], spread=GRAIN, measure=measure)
    named = salted_join(named, days, ["date"], spread=GRAIN, measure=measure)
    return named.select(
        "date",
        "store_code",
        "region",
        "store_type",
        "sku",
        "category",
        "brand",
        "day_of_week",
        "month",
        "quarter",
        "is_holiday",
        "quantity",
        "unit_price",
        "total_amount",
        "list_price",
        F.coalesce("promo_discount_pct", F.lit(0)).alias("promo_discount_pct"),
        F.when(F.col("promo_id").isNotNull(), 1).otherwise(0).alias("on_promotion"),
        "on_hand_qty",
        F.when(F.col("is_stockout"), 1).otherwise(0).alias("stockout_flag"),
    )


def marked_orphans(sales: DataFrame, store: DataFrame, product: DataFrame, calendar: DataFrame) -> DataFrame:
    """All sales rows with ``no_store``, ``no_product`` and ``no_date``: which references are unknown.

    The distinct keys of the sales are held against the dimensions first.  Up to ``FEW_KEYS`` unknown ones are sent
    to the rows, which then stay where they are; with none, nothing is joined at all.
    """
    marks = [
        ("store_id", store.select(F.col("id").alias("store_id")), "no_store"),
        ("product_id", product.select(F.col("id").alias("product_id")), "no_product"),
        ("date", calendar.select("date"), "no_date"),
    ]
    unknown = None
    for key, dim, flag in marks:
        # distinct values combine before the shuffle: a task gives each of its keys once
        lost = sales.select(key).distinct().join(dim.distinct(), key, "left_anti").withColumn("flag", F.lit(flag))
        unknown = lost if unknown is None else unknown.unionByName(lost, allowMissingColumns=True)
    few = unknown.limit(FEW_KEYS + 1).collect()
    checked, measure = sales, HotKeys(sales, *[key for key, _, _ in marks])
    for key, dim, flag in marks:
        if len(few) <= FEW_KEYS:
            lost = [(r[key],) for r in few if r["flag"] == flag]
            if not lost:
                checked = checked.withColumn(flag, F.lit(False))
                continue
            keys = sales.sparkSession.createDataFrame(lost, f"_{flag} {sales.schema[key].dataType.simpleString()}").withColumn(flag, F.lit(True))
            checked = checked.join(F.broadcast(keys), F.col(key).eqNullSafe(F.col(f"_{flag}")), "left")
            checked = checked.drop(f"_{flag}").withColumn(flag, F.coalesce(flag, F.lit(False)))
        else:
            known = dim.distinct().withColumn(f"_{flag}", F.lit(True))
            checked = salted_join(checked, known, [key], "left", spread=GRAIN, measure=measure)
            checked = checked.withColumn(flag, F.col(f"_{flag}").isNull()).drop(f"_{flag}")
    return checked


def is_orphan() -> Column:
    return F.col("no_store") | F.col("no_product") | F.col("no_date")


def orphans(sales: DataFrame, store: DataFrame, product: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sales rows whose store, product or day is unknown, with the missing references named."""
    return marked_orphans(sales, store, product, calendar).where(is_orphan())


def with_holidays(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """``is_holiday`` of the day; NULL where the calendar lacks it."""
    return salted_join(df, calendar.select("date", "is_holiday"), ["date"], "left")


def resolve_keys(
    rows: DataFrame, store: DataFrame, product: DataFrame, calendar: DataFrame
) -> DataFrame:
    """Natural keys to ids: store_code -> store_id, sku -> product_id, and whether the day exists.

    Unknown keys give NULL ids; a code that several stores have gives a row for each.
    """
    out = each_store(matched_keys(rows, store, product, calendar))
    return out.select(*rows.columns, "store_id", "product_id", "date_exists")


def matched_keys(rows: DataFrame, store: DataFrame, product: DataFrame, calendar: DataFrame) -> DataFrame:
    """``rows`` with ``product_id``, ``date_exists``, ``store_known`` and the stores of the code as a list.

    Stores of one code are a list until ``each_store``, so that only single rows are shuffled and judged.
    """
    known = F.col("id").isNotNull().alias("store_known")
    stores = store.groupBy(F.col("code").alias("store_code"), known).agg(F.collect_list(F.struct("id")).alias("_stores"))
    products = product.select("sku", F.col("id").alias("product_id"))
    days = calendar.select("date").distinct().withColumn("date_exists", F.lit(True))
    measure = HotKeys(rows, "store_code", "sku", "date")
    out = salted_join(rows, products, ["sku"], "left", measure=measure)
    out = salted_join(out, days, ["date"], "left", measure=measure)
    out = salted_join(out, stores, ["store_code"], "left", measure=measure)
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("date_exists", "store_known")})


def each_store(matched: DataFrame) -> DataFrame:
    """A row with ``store_id`` for every store of the row's code, one with NULL for none."""
    named = matched.withColumn("_store", F.explode_outer("_stores")).withColumn("store_id", F.col("_store.id"))
    return named.drop("_store", "_stores", "store_known")

"""The retail star schema: three dimensions, four facts and the model-run log.

``load_star`` derives it from TPC-H-like parquet files.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators.scale import salted_join

TABLES = (
    "store",
    "product",
    "calendar",
    "sales_daily",
    "price_history",
    "promotion",
    "inventory_snapshot_daily",
)
FIRST_DAY = dt.date(1995, 1, 1)  # of the derived prices and promotions
#: Order lines that one task groups or sorts, and the tasks up to which their number is left to the session.
TASK_ROWS, FEW_TASKS = 500_000, 4


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Star:
    """Lazily derived tables; nothing runs until a table is used."""

    spark: SparkSession
    folder: str
    _raw: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def raw(self, name: str) -> DataFrame:
        """A given table; its schema is read once."""
        if name not in self._raw:
            self._raw[name] = read_table(self.spark, self.folder, name)
        return self._raw[name]

    @cached_property
    def tasks(self) -> int | None:
        """Tasks that the order lines are dealt to, so that one holds no more of a larger table; ``None`` for a small one.

        Parquet files tell their rows without being read.
        """
        wanted = -(-self.raw("lineitem").count() // TASK_ROWS)
        return wanted if wanted > FEW_TASKS else None

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows as many as the order lines, dealt by ``keys`` to ``tasks``."""
        return rows if self.tasks is None else rows.repartition(self.tasks, *keys)

    @cached_property
    def store(self) -> DataFrame:
        # The list of nations (25 rows in this schema) is a lookup map: joining it would make the optimizer take the product of
        # the table sizes as the size of the stores and shuffle the facts to join them.
        nations = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        entry = F.struct(F.col("n_nationkey").cast("int"), F.struct("n_name", "r_name"))
        lookup = nations.agg(F.map_from_entries(F.collect_set(entry))).scalar()
        return (
            self.raw("supplier")
            .withColumn("place", F.try_element_at(lookup, F.col("s_nationkey").cast("int")))
            .where(F.col("place").isNotNull())
            .select(
                F.col("s_suppkey").alias("id"),
                F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("code"),
                F.col("s_name").alias("name"),
                F.col("place.r_name").alias("region"),
                F.col("place.n_name").alias("city"),
                F.when(F.col("s_suppkey") % 3 == 0, "supermarket")
                .when(F.col("s_suppkey") % 3 == 1, "express")
                .otherwise("warehouse")
                .alias("store_type"),
            )
        )

    @cached_property
    def product(self) -> DataFrame:
        price = F.col("p_retailprice")
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            price.cast("decimal(10,2)").alias("base_price"),
            (price * F.lit(0.6)).cast("decimal(10,2)").alias("base_cost"),
        )

    @cached_property
    def span(self) -> tuple[dt.date, dt.date]:
        """First and last day of the years in which there are sales."""
        day = F.col("l_shipdate")
        first, last = self.raw("lineitem").agg(F.year(F.min(day)), F.year(F.max(day))).first()
        return (dt.date(first, 1, 1), dt.date(last, 12, 31)) if first else (FIRST_DAY, FIRST_DAY)

    @cached_property
    def calendar(self) -> DataFrame:
        day = F.col("date")
        return (
            self.spark.range(1)
            .select(F.explode(F.sequence(*map(F.lit, self.span))).alias("date"))
            .select(
                day,
                F.weekday(day).alias("day_of_week"),
                F.month(day).alias("month"),
                F.quarter(day).alias("quarter"),
                F.year(day).alias("year"),
                (F.month(day) * 100 + F.day(day)).isin(101, 704, 1225).alias("is_holiday"),
            )
        )

    def sales(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """``sales_daily`` between two days (inclusive); the bounds reach the parquet reader."""
        lines = self.raw("lineitem")
        shipped = F.col("l_shipdate")
        if start is not None:
            lines = lines.where(shipped >= F.lit(start.isoformat()).cast("timestamp_ntz"))
        if end is not None:
            after = end + dt.timedelta(days=1)
            lines = lines.where(shipped < F.lit(after.isoformat()).cast("timestamp_ntz"))
        qty, amount = F.sum("l_quantity"), F.sum("l_extendedprice")
        grain = ("date", "store_id", "product_id")
        facts = lines.select(
            shipped.cast("date").alias("date"),
            F.col("l_suppkey").alias("store_id"),
            F.col("l_partkey").alias("product_id"),
            "l_quantity",
            "l_extendedprice",
        )
        # few lines share a grain, so grouping them before they are dealt would only hold them in memory
        return self.dealt(facts, *grain).groupBy(*grain).agg(
            qty.cast("int").alias("quantity"),
            (F.floor(amount * 100 / qty) / 100).cast("decimal(10,2)").alias("unit_price"),
            amount.cast("decimal(12,2)").alias("total_amount"),
        )

    @cached_property
    def sales_daily(self) -> DataFrame:
        return self.sales()

    @cached_property
    def price_history(self) -> DataFrame:
        key, k = F.col("p_partkey"), F.col("k")
        day0 = F.lit(FIRST_DAY)
        return (
            self.raw("part")
            .select("p_partkey", "p_retailprice", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
            .select(
                key.alias("product_id"),
                F.when(key % 10 == 0, key % 7).alias("store_id"),
                F.round(F.col("p_retailprice") * (100 + (key % 5 - 2) * k) / 100, 2)
                .cast("decimal(10,2)")
                .alias("price"),
                F.date_add(day0, k * 600).alias("valid_from"),
                F.when(k < 4, F.date_add(day0, k * 600 + 599)).alias("valid_to"),
            )
        )

    @cached_property
    def promotion(self) -> DataFrame:
        key, k = F.col("p_partkey"), F.col("k")
        first = k * 240 + (key * 37 % 200).cast("int")
        return (
            self.raw("part")
            .where(key % 3 == 0)
            .select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
            .select(
                (key * 10 + k).alias("id"),
                key.alias("product_id"),
                F.when(key % 9 == 0, key % 7).alias("store_id"),
                F.element_at(
                    F.array(*[F.lit(n) for n in ("Weekly Special", "Flash Sale", "Clearance", "Holiday Promo")]),
                    (k % 4 + 1).cast("int"),
                ).alias("name"),
                F.when(key % 2 == 0, ((1 + k % 5) / 10.0).cast("decimal(5,4)")).alias("discount_pct"),
                F.when(key % 2 == 1, (1 + k % 5).cast("decimal(10,2)")).alias("discount_amount"),
                F.date_add(F.lit(FIRST_DAY), first).alias("start_date"),
                F.date_add(F.lit(FIRST_DAY), first + 13 + (key % 20).cast("int")).alias("end_date"),
            )
        )

    @cached_property
    def inventory_snapshot_daily(self) -> DataFrame:
        mix = F.col("store_id") * 31 + F.col("product_id") * 17 + F.col("quantity")
        empty = mix % 20 == 0
        return self.sales_daily.select(
            "date",
            "store_id",
            "product_id",
            F.when(empty, 0).otherwise(mix % 400).cast("int").alias("on_hand_qty"),
            F.when(empty, 200).otherwise(0).cast("int").alias("on_order_qty"),
            empty.alias("is_stockout"),
        )

    @cached_property
    def model_run(self) -> DataFrame:
        key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        return self.raw("orders").select(
            F.md5(key.cast("string")).alias("run_id"),
            F.when(F.col("o_orderstatus") == "P", "pending")
            .when(F.col("o_orderstatus") == "F", "failed")
            .otherwise("success")
            .alias("status"),
            F.when(key % 3 == 0, "naive")
            .when(key % 3 == 1, "seasonal_naive")
            .otherwise("moving_average")
            .alias("model_type"),
            F.substring(
                F.md5(F.concat((key % 3).cast("string"), F.lit("-"), (key % 4).cast("string"))), 1, 16
            ).alias("config_hash"),
            (F.col("o_custkey") % 10).alias("store_id"),
            (F.col("o_custkey") % 20).alias("product_id"),
            day.alias("data_window_start"),
            F.date_add(day, 90).alias("data_window_end"),
            (F.col("o_totalprice") / 1000).cast("double").alias("mae"),
            F.col("o_orderdate").alias("created_at"),
        )

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


def load_star(spark: SparkSession, folder: str, register: bool = False) -> Star:
    """The star over ``folder``; with ``register`` each table becomes a temporary view."""
    star = Star(spark, folder)
    if register:
        for name in TABLES:
            star.table(name).createOrReplaceTempView(name)
    return star


# -- series readers -----------------------------------------------------------


def load_series(
    sales: DataFrame,
    start: dt.date,
    end: dt.date,
    entities: DataFrame | None = None,
    entity_columns: tuple[str, ...] = ("store_id", "product_id"),
    columns: tuple[str, ...] = ("quantity", "unit_price", "total_amount"),
) -> DataFrame:
    """Every series between two days (both inclusive); ``entities`` keeps only the wanted ones."""
    wanted = sales.where(F.col("date").between(start, end)).select(*entity_columns, "date", *columns)
    if entities is not None:
        keys = entities.select(*entity_columns).distinct()
        wanted = salted_join(wanted, keys, list(entity_columns), "left_semi", spread=["date"])
    return wanted


def load_calendar(calendar: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Calendar rows between two days (both inclusive)."""
    return calendar.where(F.col("date").between(start, end))


def daily_series(sales: DataFrame, entity: tuple[str, ...]) -> DataFrame:
    """One row per entity and day, so a series never has more rows than the calendar has days."""
    return sales.groupBy(*entity, "date").agg(
        F.sum("quantity").alias("quantity"),
        F.try_divide(F.sum("total_amount").cast("double"), F.sum("quantity").cast("double")).alias("unit_price"),
        F.sum("total_amount").alias("total_amount"),
    )

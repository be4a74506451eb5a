"""Batch validation, data-quality checks and the integrity report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.operators.exog import each_store, is_orphan, marked_orphans, matched_keys

CODE_CHARS, SKU_CHARS = 20, 50


# -- ingest ---------------------------------------------------------------------


def _two_decimals(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType):
        if kind.scale <= 2:
            return F.lit(True)
        return value == value.cast(T.DecimalType(kind.precision, 2))
    exact = value.cast("decimal(38,10)")
    return exact == F.round(exact, 2)


def row_rule_error(schema: T.StructType) -> Column:
    """Code of the first field rule a row of this schema breaks, NULL when it breaks none.

    ``total_amount`` is trusted as sent: it need not equal quantity times price.
    """
    def length_in(c: str, most: int) -> Column:
        return F.coalesce(F.char_length(F.col(c)).between(1, most), F.lit(False))

    def amount(c: str) -> Column:
        exact = _two_decimals(F.col(c), schema[c].dataType)
        return F.coalesce((F.col(c) >= 0) & exact, F.lit(False))

    rules = [
        (F.col("date").isNotNull(), "BAD_DATE"),
        (length_in("store_code", CODE_CHARS), "BAD_STORE_CODE"),
        (length_in("sku", SKU_CHARS), "BAD_SKU"),
        (F.coalesce(F.col("quantity") >= 0, F.lit(False)), "BAD_QUANTITY"),
        (amount("unit_price"), "BAD_UNIT_PRICE"),
        (amount("total_amount"), "BAD_TOTAL_AMOUNT"),
    ]
    return F.coalesce(*[F.when(~holds, code) for holds, code in rules])


def _message() -> Column:
    code = F.col("error_code")
    return (
        F.when(code == "UNKNOWN_STORE", F.format_string("Store code '%s' not found", "store_code"))
        .when(code == "UNKNOWN_PRODUCT", F.format_string("SKU '%s' not found", "sku"))
        .when(code == "UNKNOWN_DATE", F.format_string("Date '%s' not found in calendar", F.col("date").cast("string")))
        .when(code.isNotNull(), F.concat(F.lower(F.translate(code, "_", " ")), F.lit(" value")))
    )


def judge(rows: DataFrame, store: DataFrame, product: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every row with its ids, an ``error_code`` (NULL = good) and a message.

    Field rules come first, then the first unknown key of store, product, date.  A row is judged once, and comes
    out once for each store of its code.
    """
    matched = matched_keys(rows, store, product, calendar)
    unknown = (
        F.when(~F.col("store_known"), "UNKNOWN_STORE")
        .when(F.col("product_id").isNull(), "UNKNOWN_PRODUCT")
        .when(~F.col("date_exists"), "UNKNOWN_DATE")
    )
    judged = matched.withColumn("error_code", F.coalesce(row_rule_error(rows.schema), unknown)).withColumn("error_message", _message())
    return each_store(judged).select(*rows.columns, "store_id", "product_id", "error_code", "error_message")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("error_code").isNull()).select(
        "row_index", "date", "store_id", "product_id", "quantity", "unit_price", "total_amount"
    )


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("error_code").isNotNull()).select(
        "row_index", "store_code", "sku", "date", "error_code", "error_message"
    )


def batch_summary(judged: DataFrame) -> DataFrame:
    bad = F.col("error_code").isNotNull()
    return judged.agg(
        F.count_if(~bad).alias("processed_count"),
        F.count_if(bad).alias("rejected_count"),
        F.count(F.lit(1)).alias("total_received"),
    )


# -- checks on stored tables --------------------------------------------------------


def duplicates(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    """One row: how many keys occur more than once and how many rows that is too many."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return sizes.agg(
        F.lit(check).alias("check"),
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("surplus_rows"),
    )


def grain_report(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    report = None
    for check, (df, keys) in tables.items():
        one = duplicates(df, keys, check)
        report = one if report is None else report.unionByName(one)
    return report


# table -> rule name -> rule; a rule that is NULL holds, as in a CHECK constraint
CONSTRAINTS = {
    "calendar": {
        "day_of_week": "day_of_week >= 0 and day_of_week <= 6",
        "month": "month >= 1 and month <= 12",
        "quarter": "quarter >= 1 and quarter <= 4",
    },
    "sales_daily": {
        "quantity_positive": "quantity >= 0",
        "price_positive": "unit_price >= 0",
        "amount_positive": "total_amount >= 0",
    },
    "price_history": {
        "price_positive": "price >= 0",
        "valid_dates": "valid_to is null or valid_to >= valid_from",
    },
    "promotion": {
        "valid_dates": "end_date >= start_date",
        "discount_pct_range": "discount_pct is null or (discount_pct >= 0 and discount_pct <= 1)",
        "discount_amount_positive": "discount_amount is null or discount_amount >= 0",
    },
    "inventory_snapshot_daily": {
        "on_hand_positive": "on_hand_qty >= 0",
        "on_order_positive": "on_order_qty >= 0",
    },
}


def constraint_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that break each rule; one aggregation pass per table, whatever its number of rules."""
    report = None
    for table, df in tables.items():
        rules = CONSTRAINTS[table]
        counts = df.agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()],
        )
        pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
        long = counts.select(
            F.lit(table).alias("table_name"), F.col("_rows").alias("rows"), F.inline(pairs)
        )
        report = long if report is None else report.unionByName(long)
    return report


def integrity_report(sales: DataFrame, store: DataFrame, product: DataFrame, calendar: DataFrame) -> DataFrame:
    """Five checks with status passed, warning or failed; the three on the sales share one pass over them."""
    rows = F.count(F.lit(1))
    facts = marked_orphans(sales, store, product, calendar).agg(
        F.count_if(is_orphan()).alias("foreign_keys"),
        F.count_if(F.col("quantity") < 0).alias("non_negative"),
        rows.alias("data_presence"),
    )
    span = F.datediff(F.max("date"), F.min("date")) + 1
    days = calendar.agg(F.coalesce(span - rows, F.lit(0)).alias("calendar_coverage"))
    sizes = store.agg(rows.alias("n")).unionAll(product.agg(rows.alias("n"))).unionAll(calendar.agg(rows.alias("n")))
    smallest = sizes.agg(F.min("n").alias("dimension_completeness"))

    def checks(source: DataFrame, wanted: dict[str, tuple[str, bool]]) -> DataFrame:
        cells = [
            F.struct(
                F.lit(name).alias("check"),
                F.when(F.col(name) == 0 if zero else F.col(name) > 0, "passed").otherwise(bad).alias("status"),
                F.col(name).cast("long").alias("found"),
            )
            for name, (bad, zero) in wanted.items()
        ]
        return source.select(F.inline(F.array(*cells)))

    report = checks(facts, {"foreign_keys": ("failed", True), "non_negative": ("failed", True), "data_presence": ("warning", False)})
    report = report.unionByName(checks(days, {"calendar_coverage": ("warning", True)}))
    return report.unionByName(checks(smallest, {"dimension_completeness": ("warning", False)}))

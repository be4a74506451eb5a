"""Writers: merged tables, results and fitted models.

A table is never changed in place.  ``upsert`` and ``insert_new`` return the new state of a table, which
``write_version`` stores below a new path; ``versions`` applies them to the touched partitions of a large table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAIN = ("date", "store_id", "product_id")
MEASURES = ("quantity", "unit_price", "total_amount")


def last_per_key(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest ``order`` per key.

    An aggregate, not a window: many copies of one key shrink to one row per task before the shuffle.
    """
    rest = [c for c in batch.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col(order)).alias("_row")
    return batch.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str] = GRAIN,
    columns: Sequence[str] = MEASURES,
    row_index: str = "row_index",
    updated_at: str | None = None,
) -> DataFrame:
    """``target`` with the rows of ``batch`` inserted, or updated where the key is known.

    A key that occurs twice in the batch takes its last row by ``row_index``.  With ``updated_at``
    the written rows carry the current time in that column, other rows keep theirs.
    """
    keys = list(keys)
    newest = last_per_key(batch.select(*keys, *columns, row_index), keys, row_index)
    fresh = newest.select(*keys, F.struct(*columns).alias("_new"))
    merged = target.join(fresh, keys, "full")
    written = F.col("_new").isNotNull()
    out = [*keys]
    for c in columns:
        out.append(F.when(written, F.col(f"_new.{c}").cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c))
    for c in target.columns:
        if c in keys or c in columns:
            continue
        if c == updated_at:
            out.append(F.when(written, F.current_timestamp()).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    if updated_at and updated_at not in target.columns:
        out.append(F.when(written, F.current_timestamp()).alias(updated_at))
    return merged.select(*out)


def new_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str] = GRAIN) -> DataFrame:
    """The rows of ``batch`` whose key ``target`` lacks, in its columns; the least of equal new keys."""
    keys = list(keys)
    rest = [c for c in target.columns if c not in keys]
    first = F.min(F.struct(*rest)).alias("_row")
    single = batch.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return single.join(target.select(*keys), keys, "left_anti").select(*target.columns)


def insert_new(target: DataFrame, batch: DataFrame, keys: Sequence[str] = GRAIN) -> DataFrame:
    """``target`` plus the rows of ``batch`` whose key is new; the least of equal new keys is kept."""
    return target.unionByName(new_rows(target, batch, keys))


def write_version(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()) -> str:
    """Write a new version below ``folder`` and give back its path."""
    path = f"{folder.rstrip('/')}/{name}/version={uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def write_results(df: DataFrame, path: str) -> None:
    """Backtest results as JSON lines, one folder per ``backtest_id`` when that column exists."""
    writer = df.write.mode("errorifexists")
    if "backtest_id" in df.columns:
        writer = writer.partitionBy("backtest_id")
    writer.json(path)


def fit_table(state: DataFrame) -> DataFrame:
    """Fitted states with a hash over the whole row."""
    return state.withColumn("bundle_hash", F.substring(F.sha2(F.to_json(F.struct(*state.columns)), 256), 1, 16))


def write_fit_table(state: DataFrame, path: str) -> None:
    fit_table(state).write.mode("errorifexists").partitionBy("model_type").parquet(path)


def read_fit_table(spark: SparkSession, path: str, model_type: str | None = None) -> DataFrame:
    fits = spark.read.parquet(path)
    return fits if model_type is None else fits.where(F.col("model_type") == model_type)


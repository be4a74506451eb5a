"""Tables in partitions whose versions share what did not change.

A table lies below a folder.  Every write puts its rows into a folder of its own, one partition below another, and
then writes a version: a short list of which folders make up which partition.  A write that touches one
month therefore reads and writes that month; all others stay where they are.  A write that dies leaves the
version before it as it was, and a repeated one starts from there.  Of two writers that start from one version,
the one that finds the next number taken fails; on stores without an atomic check, a table has one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfline.sources.sinks import GRAIN, MEASURES, new_rows, upsert

_VERSION = "version long, value string, folder string, schema string, note string"


@dataclass(frozen=True)
class Layout:
    """A partition column (text) and how it follows from a row; ``inputs`` are the columns it needs."""

    column: str
    inputs: tuple[str, ...]
    of: Callable[[], Column]


def by_month(date: str = "date") -> Layout:
    """A partition a month; rows without a date have one of their own."""
    return Layout("month", (date,), lambda: F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none")))


def by_bucket(keys: Sequence[str], buckets: int) -> Layout:
    """Rows of equal keys in one of ``buckets`` partitions.

    A small change to a large table touches few rows but, with many keys, all buckets: choose as many
    buckets as a change has keys, at the least.
    """
    return Layout("bucket", tuple(keys), lambda: F.concat(F.lit("b"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")))


@dataclass(frozen=True)
class Version:
    """The folders of each partition, and a note that was written with them."""

    number: int
    schema: StructType
    folders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    note: dict = field(default_factory=dict)


def current(spark: SparkSession, path: str) -> Version | None:
    """The last version of the table; ``None`` before the first."""
    try:
        listed = spark.read.schema(_VERSION).json(f"{path}/versions")
        last = listed.agg(F.max("version")).first()[0]
    except AnalysisException:  # nothing there yet
        return None
    if last is None:
        return None
    rows = listed.where(F.col("version") == last).collect()  # a row for each folder of a partition
    folders: dict[str, tuple[str, ...]] = {}
    for r in sorted((r for r in rows if r["value"] is not None), key=lambda r: (r["value"], r["folder"])):
        folders[r["value"]] = (*folders.get(r["value"], ()), r["folder"])
    return Version(last, StructType.fromJson(json.loads(rows[0]["schema"])), folders, json.loads(rows[0]["note"]))


def touched(batch: DataFrame, layout: Layout) -> list[str]:
    """The partitions that rows of ``batch`` belong to: months of the calendar, or buckets."""
    return sorted(r[0] for r in batch.select(layout.of().alias(layout.column)).distinct().collect())


def read(spark: SparkSession, path: str, layout: Layout, values: Sequence[str] | None = None, version: Version | None = None) -> DataFrame:
    """The rows of the table, or of some partitions; only their folders are listed."""
    version = version or current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version below {path}")
    wanted = version.folders if values is None else {v: version.folders[v] for v in values if v in version.folders}
    paths = [f"{path}/data/commit={folder}/{layout.column}={value}" for value, folders in wanted.items() for folder in folders]
    if not paths:
        return spark.createDataFrame([], version.schema)
    stored = spark.read.schema(StructType([*version.schema.fields]).add(layout.column, "string").add("commit", "string"))
    rows = stored.option("basePath", f"{path}/data").parquet(*paths)
    if values is not None:
        rows = rows.where(F.col(layout.column).isin(list(wanted)))
    return rows.drop("commit", layout.column)


def _write(rows: DataFrame, path: str, layout: Layout) -> tuple[str, list[str]]:
    """A new folder with the rows by partition, and the partitions that have any."""
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    target = f"{path}/data/commit={folder}"
    rows.withColumn(layout.column, layout.of()).write.partitionBy(layout.column).parquet(target)
    written = spark.read.schema(StructType([*rows.schema.fields]).add(layout.column, "string")).parquet(target)
    return folder, sorted(r[0] for r in written.select(layout.column).distinct().collect())


def _publish(spark: SparkSession, path: str, version: Version) -> Version:
    fixed = (version.schema.json(), json.dumps(version.note))
    rows = [(version.number, v, f, *fixed) for v, folders in version.folders.items() for f in folders] or [(version.number, None, None, *fixed)]
    spark.createDataFrame(rows, _VERSION).coalesce(1).write.mode("errorifexists").json(f"{path}/versions/number={version.number:09d}")
    return version


def create(rows: DataFrame, path: str, layout: Layout, note: dict | None = None) -> Version:
    """The first version of a table."""
    folder, values = _write(rows, path, layout)
    return _publish(rows.sparkSession, path, Version(0, rows.schema, {v: (folder,) for v in values}, note or {}))


def replace(rows: DataFrame, path: str, layout: Layout, values: Sequence[str], before: Version, note: dict | None = None) -> Version:
    """A version in which the partitions ``values`` hold ``rows`` instead; those without rows are gone."""
    folder, written = _write(rows.select(*before.schema.names), path, layout)
    if not set(written) <= set(values):
        raise ValueError(f"rows of other partitions: {sorted(set(written) - set(values))[:5]}")
    folders = {v: f for v, f in before.folders.items() if v not in set(values)} | {v: (folder,) for v in written}
    return _publish(rows.sparkSession, path, Version(before.number + 1, before.schema, folders, before.note if note is None else note))


def append(rows: DataFrame, path: str, layout: Layout, before: Version, note: dict | None = None) -> Version:
    """A version with ``rows`` added; nothing that is there is read or written."""
    folder, written = _write(rows.select(*before.schema.names), path, layout)
    folders = before.folders | {v: (*before.folders.get(v, ()), folder) for v in written}
    return _publish(rows.sparkSession, path, Version(before.number + 1, before.schema, folders, before.note if note is None else note))


def rewrite(spark: SparkSession, path: str, layout: Layout, most: int = 8) -> Version:
    """A version in which partitions that appends have spread over more than ``most`` folders are one folder again.

    The rows stay the same; files of such a partition come out at the size that the session advises.
    """
    before = current(spark, path)
    values = [v for v, folders in before.folders.items() if len(folders) > most]
    if not values:
        return before
    rows = read(spark, path, layout, values, before)
    # adaptive execution joins small pieces and splits large ones, so no partition has to fit into a task
    return replace(rows.withColumn(layout.column, layout.of()).hint("rebalance", layout.column).drop(layout.column), path, layout, values, before)


def upsert_into(
    path: str,
    batch: DataFrame,
    layout: Layout,
    keys: Sequence[str] = GRAIN,
    columns: Sequence[str] = MEASURES,
    row_index: str = "row_index",
    updated_at: str | None = None,
) -> Version:
    """``sinks.upsert`` into the partitions that the batch touches; the keys must determine the partition."""
    spark, before = batch.sparkSession, current(batch.sparkSession, path)
    if not set(layout.inputs) <= set(keys):
        raise ValueError(f"a change of {layout.inputs} would move a row to another partition")
    values = touched(batch, layout)
    merged = upsert(read(spark, path, layout, values, before), batch, keys, columns, row_index, updated_at)
    return replace(merged, path, layout, values, before)


def insert_new_into(path: str, batch: DataFrame, layout: Layout, keys: Sequence[str] = GRAIN) -> Version:
    """``sinks.insert_new`` into a table: keys of touched partitions are read, only new rows are written."""
    spark, before = batch.sparkSession, current(batch.sparkSession, path)
    if not set(layout.inputs) <= set(keys):
        raise ValueError(f"a key may lie in several partitions of {layout.inputs}")
    known = read(spark, path, layout, touched(batch, layout), before)
    return append(new_rows(known, batch, keys), path, layout, before)

"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.operators.scale import new_path

#: The white space that separates words, as a Java and SQL character class.
WORD = "[^\\x20\\x09-\\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_NOTED: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the cluster's shared folder and read it back.

    Cuts the lineage and pays for an expensive column once.  The files are shared, so a lost
    executor costs nothing that was written.  They stay until ``discard`` or the owner of the folder removes them.
    """
    path = new_path(df.sparkSession, name)
    for paths in _NOTED:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of all tables that are stored meanwhile, in order."""
    paths: list[str] = []
    _NOTED.append(paths)
    try:
        yield paths
    finally:
        _NOTED.pop()  # the last one opened


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove stored tables that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def text_key(df: DataFrame, id_column: str, column: str = "text") -> Column:
    """64 bits that tell apart rows of one id with other texts."""
    return F.xxhash64(df[id_column], df[column])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put in front until they clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def hash_sample(df: DataFrame, keys: Sequence[str], rows: int, count: int | None = None) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes of ``keys``.

    Rows that are clearly beyond are left out before the sort, so the one task that ends it gets little
    more than ``rows``, whatever the size of the table.
    """
    count = df.count() if count is None else count
    key = F.xxhash64(F.lit("sample"), *keys)
    if count > rows:
        share = min(1.0, (rows + 10 * rows**0.5 + 100) / count)
        df = df.where(F.pmod(key, F.lit(1 << 40)) < int(share * (1 << 40)))
    return df.orderBy(F.pmod(key, F.lit(1 << 40)), *keys).limit(rows)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value: histograms of narrowing ranges, of which only bin counts are collected.

    With fewer than ``k`` values the least one; infinity without any.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return math.inf
    above = 0  # values beyond the range
    while low < high:
        width = (high - low) / bins
        if width <= 0 or not math.isfinite(width):
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width).cast("int"))
        found = df.where(F.col(column).between(low, high)).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        before = (low, high)
        for b in sorted(found.collect(), key=lambda r: -r["b"]):
            if above + b["n"] >= k:
                low, high = b["lo"], b["hi"]
                break
            above += b["n"]
        else:
            return float(low)
        if (low, high) == before:
            break
    return float(low)


def running_sum(df: DataFrame, group: str, hex_key: str, ties: Sequence[str], value: str, per_group: DataFrame | None = None) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same ``group`` that stand earlier.

    Rows stand in the order of ``hex_key`` (lowercase hex digits of a hash, so evenly spread) and
    ``ties``.  The range of the key is cut into equal buckets, each bucket is summed on its own and
    shifted by the sums of the buckets before it: a group that holds a third of all rows is spread
    over all tasks, and only one row per group and bucket meets in a window.  ``group`` must not be
    null.  Columns of ``per_group`` (one row per group) are added on the way.  The result does not
    depend on the number of buckets.
    """
    buckets = 4 * partitions(df.sparkSession)
    at = F.floor(F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32))
    rows = df.withColumn("_bucket", at.cast("int"))
    sums = rows.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.withColumn("_shift", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    if per_group is not None:
        shifts = shifts.join(per_group, group)
    within = Window.partitionBy(group, "_bucket").orderBy(hex_key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(shifts, [group, "_bucket"]).withColumn("before", F.col("_local") + F.col("_shift")).drop("_bucket", "_local", "_shift")


def by_batch(df: DataFrame, work, schema: str, size: int = 16 << 20) -> DataFrame:
    """``mapInArrow`` whose batches are cut to about ``size`` bytes.

    ``work`` takes one ``pyarrow.RecordBatch`` and returns one (or None).  A batch of long texts
    would otherwise hold thousands of them in a Python worker at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, size):
                out = work(piece)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Halve a batch until a part is small or a single row."""
    if batch.num_rows <= 1 or batch.nbytes <= size:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from cut(batch.slice(0, half), size)
        yield from cut(batch.slice(half), size)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each row starts (and the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that are a fixed function of 64-bit keys."""
    x = keys.astype(np.int64).view(np.uint64).copy()
    with np.errstate(over="ignore"):
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x ^= x >> np.uint64(31)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(29)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def crc32_sql(text: str) -> str:
    """A DuckDB expression for the CRC-32 of an ASCII string expression, bit by bit."""
    start, polynomial = (1 << 32) - 1, 0xEDB88320
    letters = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::bigint)"
    bits = "lambda v, bit: xor(v >> 1, {0}::bigint * (v & 1))".format(polynomial)
    letter = f"lambda c, l: list_reduce(list_prepend(xor(c, l), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), {bits})"
    return f"xor(list_reduce(list_prepend({start}::bigint, {letters}), {letter}), {start}::bigint)"

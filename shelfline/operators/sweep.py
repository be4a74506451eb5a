"""Joins of dated rows with validity windows, by a sweep over each group in date order.

Rows and windows of a key meet in one task, sorted by key.  In date order the rows that a window covers are one
run, found by two binary searches, so the work grows with rows, windows and matches, not with their
product.  Keys that hold a large share of the rows are cut into stretches of days, and a window goes to every
stretch in which it is open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.operators.scale import HotKeys, key_hash

#: Matches that a task makes at once.
MATCHES = 1 << 17


def stretches(rows: DataFrame, key: str, date: str, measure: HotKeys) -> DataFrame | None:
    """``_key, _from, _to, _salt, _salts, _part``: days of the hot keys that hold about a shuffle partition of rows each.

    A day of more rows than that is dealt to several salts.  ``None`` without a hot key.
    """
    spark = rows.sparkSession
    hot = measure.parts(key)
    if not hot:
        return None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = max(1, measure.totals()[0] // tasks)
    names = spark.createDataFrame([(h,) for h, _ in hot], "_hash long")
    held = rows.select(F.col(key).alias("_key"), F.col(date).alias("_day")).where(F.col("_day").isNotNull() & F.col("_key").isNotNull())
    held = held.join(F.broadcast(names), key_hash([F.col("_key")]) == F.col("_hash"), "left_semi")
    # one row for each day of a hot key
    days = held.groupBy("_key", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = days.withColumn("_piece", F.floor(before / target)).groupBy("_key", "_piece")
    cut = cut.agg(F.min("_day").alias("_from"), F.max("_day").alias("_to"), F.sum("_n").alias("_rows"))
    salts = F.when(F.col("_from") == F.col("_to"), F.greatest(F.lit(1), F.ceil(F.col("_rows") / (2 * target)))).otherwise(F.lit(1)).cast("int")
    cut = cut.withColumn("_salts", salts).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_piece", "_salt"))
    # about as many rows as tasks: collected once, so that both sides see the same borders
    found = cut.select("_key", "_from", "_to", "_salt", "_salts", number.alias("_part")).collect()
    kinds = [rows.schema[key].dataType.simpleString(), *["date"] * 2, *["int"] * 3]
    names = ["_key", "_from", "_to", "_salt", "_salts", "_part"]
    return spark.createDataFrame(found, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def sweep_join(
    rows: DataFrame,
    windows: DataFrame,
    key: str,
    date: str,
    within: str,
    window_within: str,
    first: str,
    last: str,
    how: str = "left",
    measure: HotKeys | None = None,
) -> DataFrame:
    """``rows`` with the windows of their ``key`` that cover ``date`` (inclusive; a NULL ``last`` is open).

    A window counts for rows whose ``within`` equals its ``window_within``, or for all if that is NULL.  ``how``: inner,
    left, left_semi or left_anti.  The sides may share no column but ``key``.  ``measure`` holds the hot keys of
    ``rows``, or of the table they come from.
    """
    payload = [f for f in windows.schema.fields if f.name != key]
    kind = rows.select(key).union(windows.select(key)).schema[0].dataType
    measure = measure or HotKeys(rows, key)
    cut = stretches(rows, key, date, measure)
    placed = rows.withColumn("_part", F.lit(0))
    open_in = windows.where(F.col(key).isNotNull() & F.col(first).isNotNull()).withColumn("_part", F.lit(0))
    if cut is not None:
        day, salt = F.col(date), F.pmod(F.xxhash64(*rows.columns), F.col("_salts"))
        mine = (F.col(key) == F.col("_key")) & day.between(F.col("_from"), F.col("_to")) & (salt == F.col("_salt"))
        placed = rows.join(F.broadcast(cut), mine, "left").select(*rows.columns, F.coalesce("_part", F.lit(0)).alias("_part"))
        touched = (F.col(key) == F.col("_key")) & (F.col(first) <= F.col("_to")) & (F.col(last).isNull() | (F.col(last) >= F.col("_from")))
        open_in = open_in.drop("_part").join(F.broadcast(cut), touched, "left")
        open_in = open_in.select(*windows.columns, F.coalesce("_part", F.lit(0)).alias("_part"))

    left_names, right_names = list(rows.columns), [f.name for f in payload]
    key_column = F.col(key).cast(kind).alias("_k")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in [*rows.schema.fields, *payload]}
    sales = placed.select(key_column, "_part", F.lit(1).alias("_role"), *left_names, *[empty[c].alias(c) for c in right_names])
    opened = open_in.select(key_column, "_part", F.lit(0).alias("_role"), *[empty[c].alias(c) for c in left_names], *right_names)
    dealt = sales.unionByName(opened).repartition("_k", "_part").sortWithinPartitions("_k", "_part", "_role")

    kept = [*rows.schema.fields, *(T.StructField(f.name, f.dataType) for f in payload)] if how in ("inner", "left") else rows.schema.fields
    columns = (left_names, right_names, date, within, window_within, first, last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("_k", "_part")):
            yield from _matched(table, columns, how)

    return dealt.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in kept]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``keys``, with their number in ``_group``; memory holds a batch and a group."""
    waiting: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        number = _numbered(table, keys)
        start = int(np.searchsorted(number, number[-1]))
        if start:
            yield table.slice(0, start).append_column("_group", pa.array(number[:start]))
        waiting = table.slice(start)
    if waiting is not None:
        yield waiting.append_column("_group", pa.array(_numbered(waiting, keys)))


def _numbered(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for key in keys:
        column = table[key].combine_chunks()
        same = pc.equal(column.slice(1), column.slice(0, len(column) - 1)).fill_null(False)
        both = pc.and_(column.slice(1).is_null(), column.slice(0, len(column) - 1).is_null())
        new[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _days(column: pa.ChunkedArray) -> np.ndarray:
    """Days as numbers; the mask of nulls is kept apart."""
    return column.cast(pa.int32()).fill_null(0).to_numpy().astype(np.int64)


def _matched(table: pa.Table, columns: tuple, how: str) -> Iterator[pa.RecordBatch]:
    left_names, right_names, date, within, window_within, first, last = columns
    role = table["_role"].to_numpy()
    sales, opened = table.filter(pa.array(role == 1)), table.filter(pa.array(role == 0))
    hit = np.zeros(sales.num_rows, bool)
    if sales.num_rows and opened.num_rows:
        for i, w in _pairs(sales, opened, date, within, window_within, first, last):
            hit[i] = True
            if how in ("inner", "left"):
                both = [sales[c].take(pa.array(i)) for c in left_names] + [opened[c].take(pa.array(w)) for c in right_names]
                yield from pa.table(both, names=[*left_names, *right_names]).combine_chunks().to_batches()
    alone = sales.select(left_names).filter(pa.array(hit if how == "left_semi" else ~hit))
    if how == "left":
        for c in right_names:
            alone = alone.append_column(c, pa.nulls(alone.num_rows, table.schema.field(c).type))
    if how != "inner":
        yield from alone.combine_chunks().to_batches()


def _pairs(sales: pa.Table, opened: pa.Table, date: str, within: str, window_within: str, first: str, last: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows and windows that match, some at a time."""
    dated = sales[date].is_valid().to_numpy(zero_copy_only=False)
    if not dated.any():
        return
    day = _days(sales[date])
    low, width = int(day[dated].min()), int(day[dated].max() - day[dated].min()) + 3
    begin = np.clip(_days(opened[first]) - low + 1, 0, width - 1)
    end = np.where(opened[last].is_valid().to_numpy(zero_copy_only=False), np.clip(_days(opened[last]) - low + 1, 0, width - 1), width - 1)
    group, mine = sales["_group"].to_numpy(), opened["_group"].to_numpy()
    everywhere = opened[window_within].is_null().to_numpy(zero_copy_only=False)
    placed = sales[within].is_valid().to_numpy(zero_copy_only=False)
    # codes of the values that both sides have
    code, window_code = np.zeros(len(group), np.int64), np.zeros(len(mine), np.int64)
    names = np.concatenate([sales[within].filter(pa.array(placed)).to_numpy(), opened[window_within].filter(pa.array(~everywhere)).to_numpy()])
    values, codes = np.unique(names, return_inverse=True)
    code[placed], window_code[~everywhere] = codes[: int(placed.sum())], codes[int(placed.sum()) :]
    for rows, wins, by, window_by in (
        (np.flatnonzero(dated), np.flatnonzero(everywhere), group, mine),
        (np.flatnonzero(dated & placed), np.flatnonzero(~everywhere), group * max(1, len(values)) + code, mine * max(1, len(values)) + window_code),
    ):
        if not len(rows) or not len(wins):
            continue
        place = by[rows] * width + day[rows] - low + 1
        order = np.argsort(place, kind="stable")
        place, rows = place[order], rows[order]
        start = np.searchsorted(place, window_by[wins] * width + begin[wins])
        count = np.maximum(0, np.searchsorted(place, window_by[wins] * width + end[wins], "right") - start)
        yield from _runs(rows, wins[count > 0], start[count > 0], count[count > 0])


def _runs(rows: np.ndarray, wins: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of all runs with their window, about ``MATCHES`` pairs at a time."""
    total = np.cumsum(count)
    for first in range(0, int(total[-1]) if len(total) else 0, MATCHES):
        pair = np.arange(first, min(first + MATCHES, int(total[-1])))
        at = np.searchsorted(total, pair, "right")
        yield rows[start[at] + pair - (total[at] - count[at])], wins[at]

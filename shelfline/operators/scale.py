"""Building blocks that keep a plan whole when keys are hot or tables are large.

* ``fits_broadcast``   - is a side provably small enough for a hash broadcast?
* ``HotKeys``          - the few key values that hold a large share of the rows, from a sketch
* ``salted_join``      - equi join that spreads hot keys over many tasks
* ``global_row_number``- exact 1..n numbering without a single-task window
* ``page_of``          - ORDER BY / OFFSET / LIMIT that also works for deep pages
* ``tile_borders``     - where NTILE changes, without numbering the rows
* ``durable``          - cut lineage on shared storage (never on executor disks)
* ``kept``             - the same in parquet, for what is read several times, by few columns each
"""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot from this many average shuffle partitions on (but never below ``LEAST_HOT_SHARE`` of few partitions).
HOT_PARTITIONS = 2
LEAST_HOT_SHARE = 1 / 20
#: Rows that a top-k of one task may hold, and the keys between which a round counts rows.
FETCH, SPLITTERS = 10_000, 31


# -- shared storage -----------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    It has to be set, but for a session of one machine (``local``, ``local[n]``): that gets a scratch
    folder of its own, which goes with the process.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = scratch_dir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_dir() -> str:
    """A folder of this machine that is removed when the process ends."""
    path = tempfile.mkdtemp(prefix="shelfline-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once below the shared folder and read from there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- size and skew checks -----------------------------------------------------


def fits_broadcast(df: DataFrame) -> bool:
    """True when the size of ``df`` is below the session's broadcast threshold.

    The optimizer's estimate does not count the rows that an explode makes; where there is one, a side
    that looks small is counted.  A session over Spark Connect shows no estimate: there the rows are counted.
    """
    limit = broadcast_limit(df.sparkSession)
    if limit <= 0:
        return False
    if not hasattr(df, "_jdf"):
        return df.count() * row_size(df.schema) <= limit
    if estimated_bytes(df) > limit:
        return False
    return "Generate" not in df._jdf.queryExecution().optimizedPlan().toString() or df.count() * row_size(df.schema) <= limit


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, which does not count the rows that an explode makes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes."""
    number, unit = re.fullmatch(r"(-?[0-9]+)([a-z]*)", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}[unit]


def row_size(schema: T.StructType) -> int:
    """Bytes of a row by the sizes that the optimizer assumes: 20 for a text, 100 for binary, one element of a list."""

    def size(kind: T.DataType) -> int:
        if isinstance(kind, T.StructType):
            return sum(size(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return size(kind.elementType)
        if isinstance(kind, T.MapType):
            return size(kind.keyType) + size(kind.valueType)
        known = {T.StringType: 20, T.BinaryType: 100, T.DecimalType: 16, T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
        return known.get(type(kind), 8)

    return size(schema) + 8


def hot_share(spark: SparkSession) -> float:
    """The share of the rows from which a key is split: a multiple of an average shuffle partition."""
    return min(LEAST_HOT_SHARE, HOT_PARTITIONS / int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Groups of tasks that merge their sketches before the last step.
SKETCH_GROUPS = 64
_MOST_TRACKED = 1_000_000


class HotKeys:
    """The hot values of join keys of a table, found when first asked for, by one pass that shuffles sketches only.

    A key is a column name or several.  Every task counts the hashes of its key values in a sketch of frequent
    items, eight counters for each key that can be hot, and the sketches merge.  Counts are estimates: a key
    that is missed or taken too many only moves work, never a row.  ``sums`` of whole-number columns are taken
    along, and the number of rows: see ``totals``.
    """

    def __init__(self, df: DataFrame, *keys: str | Sequence[str], sums: Sequence[str] = ()):
        self.df, self.keys, self.sums = df, [(k,) if isinstance(k, str) else tuple(k) for k in keys], list(sums)
        self.found: dict[float, dict[tuple, list[tuple[int, float]]]] = {}
        self.summed: tuple | None = None

    def totals(self) -> tuple:
        """The number of rows, and the sum of each column of ``sums``."""
        if self.summed is None:
            self.parts(*self.keys[0])
        return self.summed

    def parts(self, *key: str) -> list[tuple[int, float]]:
        """``(hash, part of the rows)`` of the values above the session's limit; the hash is ``key_hash``."""
        share = hot_share(self.df.sparkSession)
        if share not in self.found:
            self.found[share] = self._measure(share)
        return self.found[share][key]

    def _measure(self, share: float) -> dict[tuple, list[tuple[int, float]]]:
        most = int(1 / share) + 1
        tracked = min(_MOST_TRACKED, 8 * most)
        hashed = self.df.select(*[key_hash([F.col(c) for c in key]).alias(f"k{i}") for i, key in enumerate(self.keys)], *[F.col(c).cast("decimal(20,0)").alias(f"s{i}") for i, c in enumerate(self.sums)])
        columns = range(len(self.keys))
        sketches = [F.expr(f"approx_top_k_accumulate(k{i}, {tracked})").alias(f"k{i}") for i in columns]
        group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")
        adds = [F.sum(f"s{i}").alias(f"s{i}") for i in range(len(self.sums))]
        merged = hashed.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *adds, *sketches)
        best = [F.expr(f"approx_top_k_estimate(approx_top_k_combine(k{i}, {tracked}), {most})").alias(f"k{i}") for i in columns]
        # grouped by a constant: a partition without sketches gives nothing to combine
        row = merged.groupBy(F.lit(0).alias("all")).agg(F.sum("n").alias("n"), *adds, *best).first()
        if row is None:
            self.summed = (0, *[None for _ in self.sums])
            return {key: [] for key in self.keys}
        total = row["n"]
        self.summed = (total, *[row[f"s{i}"] for i in range(len(self.sums))])
        return {key: [(x["item"], x["count"] / total) for x in row[f"k{i}"] if x["count"] > share * total] for i, key in enumerate(self.keys)}


def key_hash(columns: Sequence[Column]) -> Column:
    """64 bits of a key; null is a value like others."""
    return F.xxhash64(*columns)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
    spread: Sequence[str] | None = None,
    measure: HotKeys | None = None,
    skew: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` on the columns ``on`` (plus ``condition``), whatever the skew of ``left``.

    A right side below the broadcast threshold is joined as is (no shuffle, so no skew).
    Otherwise the hot key values of ``left`` (NULL may be one) are found.  A key that holds a third of
    the rows is cut into a third of the shuffle partitions, by a hash of ``spread``, and only its
    partner rows are repeated once per piece.  Every left row still meets every right row of its
    key exactly once; the piece is a pure function of the row, so a recomputed task gives the same
    rows.  In a chain of joins ``measure`` names the keys of the table the chain started from: they are
    measured once for all joins, instead of ``left``, which would compute the earlier joins.
    ``skew`` names those of the columns ``on`` by which hotness is judged (all of them by default).

    Right and left may share only the ``on`` columns.  ``how``: inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support how={how!r}")
    on = list(on)
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    match = F.lit(True)
    for c in on:
        match = match & (F.col(c) == F.col(f"_r_{c}"))
    if condition is not None:
        match = match & condition
    drop = [f"_r_{c}" for c in on] if how in ("inner", "left") else []
    if fits_broadcast(right):
        return left.join(renamed, match, how).drop(*drop)
    # a side that only looks small must not be broadcast by the optimizer either
    misjudged = hasattr(right, "_jdf") and estimated_bytes(right) <= broadcast_limit(right.sparkSession)

    def match_side(side: DataFrame) -> DataFrame:
        return side.hint("merge") if misjudged else side

    by = list(skew or on)
    # the types that the join compares: both sides have to hash alike
    kinds = [left.select(c).union(renamed.select(f"_r_{c}")).schema[0].dataType for c in by]
    same = all(left.schema[c].dataType == kind for c, kind in zip(by, kinds))
    keys = measure if measure is not None and same else HotKeys(left.select(*[F.col(c).cast(kind) for c, kind in zip(by, kinds)]), by)
    found = keys.parts(*by)
    if not found:
        return left.join(match_side(renamed), match, how).drop(*drop)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = left.sparkSession.createDataFrame([(h, max(2, math.ceil(part * tasks))) for h, part in found], "_hot long, _pieces long")

    def with_pieces(side: DataFrame, prefix: str) -> DataFrame:
        """The hot keys are few by arithmetic, and rows of this table: both sides get the very same decision."""
        hashed = side.withColumn("_hash", key_hash([F.col(prefix + c).cast(kind) for c, kind in zip(by, kinds)]))
        joined = hashed.join(F.broadcast(pieces), F.col("_hash") == F.col("_hot"), "left")
        return joined.drop("_hash", "_hot").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))

    salted_left = with_pieces(left, "").withColumn(
        "_salt", F.pmod(F.xxhash64(*(spread or left.columns)), F.col("_pieces"))
    ).drop("_pieces")
    salted_right = with_pieces(renamed, "_r_").withColumn(
        "_r_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1))
    ).drop("_pieces")
    joined = salted_left.join(match_side(salted_right), match & (F.col("_salt") == F.col("_r_salt")), how)
    return joined.drop("_salt", "_r_salt", *drop)


# -- order over the whole table ----------------------------------------------


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Exact 1..n numbering in ``order`` (which must be total) with no unpartitioned window.

    The rows are range partitioned, each range is numbered on its own and shifted by the size of
    the ranges before it.  The ranges are checkpointed, since Spark samples their borders and a
    recomputed sample could move them.
    """
    order = list(order)
    ranged = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition of the table, so this window is small by construction
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
        .withColumn(name, F.col("_local").cast("long") + F.col("_before"))
        .drop("_range", "_r", "_local", "_before")
    )


# -- rows by rank ---------------------------------------------------------------


def sort_columns(order: Sequence[str]) -> list[Column]:
    """Sort expressions of column names; a leading minus means descending (NULLs stand first, or then last)."""
    return [F.desc(name[1:]) if name.startswith("-") else F.asc(name) for name in order]


def _names(order: Sequence[str]) -> list[str]:
    return [name.removeprefix("-") for name in order]


def stands_before(df: DataFrame, order: Sequence[str], row) -> Column:
    """Whether a row of ``df`` sorts before the key values in ``row``."""
    found, equal = F.lit(False), F.lit(True)
    for name, value in zip(order, row):
        column = F.col(name.removeprefix("-"))
        literal = F.lit(value).cast(df.schema[name.removeprefix("-")].dataType)
        if name.startswith("-"):
            earlier = column.isNotNull() if value is None else column > literal
        else:
            earlier = F.lit(False) if value is None else column.isNull() | (column < literal)
        found = found | (equal & F.coalesce(earlier, F.lit(False)))
        equal = equal & column.eqNullSafe(literal)
    return found


def narrowed(df: DataFrame, order: Sequence[str], first: int, last: int) -> tuple[DataFrame, int]:
    """Rows around the ranks ``first`` to ``last`` (from 0) in ``order``, and how many rows stand before them.

    A histogram is counted between some keys of the table, picked by hash; the cells that hold the ranks are all that
    the next, finer one counts.  Nothing is sorted or written: a round reads the key columns twice, and
    leaves about a thirtieth of the rows.  It ends when rank ``first`` is within the first ``FETCH`` rows left.
    """
    names, before = _names(order), 0
    while first + 1 - before > FETCH:
        keys = df.select(*names)
        picked = keys.orderBy(F.xxhash64(*names), *names).limit(SPLITTERS).distinct().orderBy(*sort_columns(order)).collect()
        cell = sum((~stands_before(df, order, row)).cast("int") for row in picked) if picked else F.lit(0)
        counts = {r["cell"]: r["n"] for r in keys.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
        skipped, low, high, seen = 0, None, None, before
        for at in sorted(counts):
            if seen + counts[at] <= first:
                skipped = seen + counts[at] - before
            elif low is None:
                low = at
            seen += counts[at]
            if seen > last:
                high = at
                break
        if low is None:  # the table ends before
            return df.where(F.lit(False)), first
        if skipped == 0 and (high is None or high == max(counts)):
            break  # equal keys: there is nothing left to tell rows apart
        rows = df
        if low > 0:
            rows = rows.where(~stands_before(df, order, picked[low - 1]))
        if high is not None and high < len(picked):
            rows = rows.where(stands_before(df, order, picked[high]))
        df, before = rows, before + skipped
    return df, before


def page_of(df: DataFrame, order: Sequence[str], page: int, size: int) -> DataFrame:
    """Page ``page`` (1-based) of ``size`` rows in ``order`` (names, a minus for descending; see ``sort_columns``).

    Pages far out are looked for by rank first, so that Spark's top-k operator never holds more than ``FETCH``
    rows and a page.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    first = (page - 1) * size
    rows, before = narrowed(df, order, first, first + size - 1)
    return rows.orderBy(*sort_columns(order)).offset(first - before).limit(size)


def tile_borders(df: DataFrame, order: Sequence[str], tiles: int) -> list:
    """The first key of each tile after the first, for ``ntile(tiles)`` in ``order``; fewer for fewer rows than tiles."""
    names = _names(order)
    ranked = F.ntile(tiles).over(Window.orderBy(*sort_columns(order)))
    place = F.row_number().over(Window.orderBy(*sort_columns(order)))
    # the window sees at most FETCH rows and one
    few = df.select(*names).limit(FETCH + 1).withColumn("_tile", ranked).withColumn("_at", place)
    found = few.groupBy("_tile").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*names), "_at").alias("key")).collect()
    if sum(r["n"] for r in found) <= FETCH:
        return [tuple(r["key"]) for r in sorted(found, key=lambda r: r["_tile"])[1:]]
    total = df.count()
    small, extra = divmod(total, tiles)
    out = []
    for tile in range(1, tiles):
        at = tile * small + min(tile, extra)
        rows, before = narrowed(df.select(*names), order, at, at)
        out.append(tuple(rows.orderBy(*sort_columns(order)).offset(at - before).limit(1).first()))
    return out

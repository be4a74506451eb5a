"""Streaming ingest of sales batches.

Each micro-batch is validated and written once, to a folder named after its stream and batch id, with the time it
arrived; a batch that is repeated after a failure overwrites its own folder and keeps its time, so nothing is
counted twice.  A batch counts from when its record is written, after its rows.  Accepted rows form a log, and
the current table is the row per grain that arrived last, whichever stream brought it.  A batch costs its own size,
never the size of the table.  ``compact`` folds the log into a table laid out by month: it reads what each stream
wrote since the last time, and rewrites the months that those rows touch.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfline.operators.quality import judge
from shelfline.sources import versions
from shelfline.sources.sinks import GRAIN, MEASURES, last_per_key

#: How a row of the table came to be; larger ones replace smaller ones.  Rows that came otherwise have the least.
ARRIVAL = "arrival"
_ARRIVAL_TYPE = "struct<arrived:bigint,stream:string,batch_id:bigint,row_index:bigint>"
_MONTHS = versions.by_month()
#: Files that a task of a batch may have open at once: more than there are statuses, so its rows need no sort to be written.
_OPEN_FILES = 4


def read_files(
    spark: SparkSession, folder: str, schema: StructType, fmt: str = "json", files_per_batch: int = 100, glob: str = "*"
) -> DataFrame:
    """A stream over the files that arrive in ``folder``."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", glob)
        .load(folder)
    )


def start_ingest(
    stream: DataFrame,
    store: DataFrame,
    product: DataFrame,
    calendar: DataFrame,
    log: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Validate each micro-batch and append it to ``log``; returns the running query.

    A batch has a folder of its own, by the stream's checkpoint and the batch id: a repeated batch
    overwrites itself, and a stream with a new checkpoint never touches the batches of another.
    Rows need row_index, date, store_code, sku, quantity, unit_price and total_amount, or are
    brought there by ``prepare``.
    """

    name = stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        at, spark = f"stream={name}/batch_id={batch_id}", batch.sparkSession
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", _OPEN_FILES)  # in the stream's own session
        arrived = _arrived(spark, f"{log}/done/{at}") or time.time_ns() // 1000
        judged = judge(rows, store, product, calendar).withColumn(
            "status", F.when(F.col("error_code").isNull(), "accepted").otherwise("rejected")
        )
        judged.withColumn("arrived", F.lit(arrived)).write.mode("overwrite").partitionBy("status").parquet(f"{log}/rows/{at}")
        spark.createDataFrame([(arrived,)], "arrived long").coalesce(1).write.mode("overwrite").parquet(f"{log}/done/{at}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_name(checkpoint: str) -> str:
    """The name in the log of the stream with this checkpoint folder."""
    return "s" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _arrived(spark: SparkSession, record: str) -> int | None:
    """When a batch arrived that was written before."""
    try:
        return spark.read.parquet(record).agg(F.min("arrived")).first()[0]
    except AnalysisException:
        return None


def high_water(spark: SparkSession, log: str) -> dict[str, int]:
    """The last finished batch of every stream; a stream writes one batch after the other."""
    try:
        done = spark.read.option("basePath", f"{log}/done").parquet(f"{log}/done")
    except AnalysisException:  # nothing there yet
        return {}
    last = done.groupBy("stream").agg(F.max("batch_id").alias("batch_id"))
    return {r["stream"]: r["batch_id"] for r in last.collect()}  # one row a stream


def _rows(spark: SparkSession, log: str, status: str, after: Mapping[str, int], upto: Mapping[str, int] | None) -> DataFrame:
    upto = high_water(spark, log) if upto is None else upto
    rows = spark.read.option("basePath", f"{log}/rows").parquet(f"{log}/rows").where(F.col("status") == status)
    wanted = F.lit(False)
    for stream, last in upto.items():  # partition columns alone: other folders are not read
        wanted = wanted | (F.col("stream") == stream) & (F.col("batch_id") > after.get(stream, -1)) & (F.col("batch_id") <= last)
    return rows.where(wanted)


def accepted_rows(spark: SparkSession, log: str, after: Mapping[str, int] | None = None, upto: Mapping[str, int] | None = None) -> DataFrame:
    """Accepted rows of finished batches; ``after`` and ``upto`` name a batch of each stream (see ``high_water``)."""
    rows = _rows(spark, log, "accepted", after or {}, upto)
    return rows.select("stream", F.col("batch_id").cast("long").alias("batch_id"), "arrived", "row_index", *GRAIN, *MEASURES)


def rejected_rows(spark: SparkSession, log: str) -> DataFrame:
    return _rows(spark, log, "rejected", {}, None).select(
        "batch_id", "row_index", "store_code", "sku", "date", "error_code", "error_message"
    )


def _ordered(rows: DataFrame) -> DataFrame:
    at = F.struct("arrived", "stream", "batch_id", F.col("row_index").cast("long").alias("row_index"))
    return rows.select(*GRAIN, *MEASURES, at.alias(ARRIVAL))


def current_sales(spark: SparkSession, log: str) -> DataFrame:
    """The last accepted row per grain: batches by the time they arrived, then later rows of a batch."""
    return last_per_key(_ordered(accepted_rows(spark, log)), GRAIN, ARRIVAL).drop(ARRIVAL)


def create_table(rows: DataFrame, path: str) -> versions.Version:
    """A table to compact into, with rows that any row of the log replaces."""
    least = F.struct(F.lit(0).alias("arrived"), F.lit("").alias("stream"), F.lit(-1).alias("batch_id"), F.lit(-1).alias("row_index"))
    return versions.create(rows.select(*GRAIN, *MEASURES, least.cast(_ARRIVAL_TYPE).alias(ARRIVAL)), path, _MONTHS)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, _MONTHS).drop(ARRIVAL)


def compact(spark: SparkSession, log: str, path: str) -> versions.Version:
    """Fold what every stream has finished since the last compaction into the table; returns its version.

    The last batch of each stream is noted with the version, so both change together.  Rows carry their
    arrival, so it does not matter which compaction brings them.
    """
    before = versions.current(spark, path)
    after, upto = before.note.get("marks", {}), high_water(spark, log)
    if upto == after:
        return before
    fresh = _ordered(accepted_rows(spark, log, after, upto))
    months = versions.touched(fresh, _MONTHS)
    table = versions.read(spark, path, _MONTHS, months, before)
    fresh = fresh.select(*[F.col(f.name).cast(f.dataType) for f in before.schema])
    merged = last_per_key(table.unionByName(fresh), GRAIN, ARRIVAL)
    return versions.replace(merged, path, _MONTHS, months, before, {**before.note, "marks": upto})

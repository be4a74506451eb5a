"""Change detection on a stream of documents.

The state is a table of source keys and content hashes, laid out in buckets of the key.  A micro-batch reads and
rewrites the buckets of its keys.  Its texts are written once, where they are read, and never shuffled: all that
is judged are hashes.  The result goes to a folder of its own too; then the state and the mark of the batch
are published in one version.  A batch that is repeated before that finds the state it found the first time
and overwrites its folders; one that is repeated after it is known by the mark and left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfline.operators.documents import SOURCE_KEY, content_hash, detect_changed_hashes
from shelfline.operators.scale import salted_join
from shelfline.sources import versions
from shelfline.sources.sinks import last_per_key
from shelfline.streaming.ingest import stream_name

BUCKETS = 256
#: Texts are most of what is written; this codec takes about two thirds of the bytes of the default one.
TEXT_CODEC = "zstd"
_STATE = "source_type string, source_path string, source_id string, content_hash string"


def state_layout(buckets: int = BUCKETS) -> versions.Layout:
    return versions.by_bucket(SOURCE_KEY, buckets)


def create_state(spark: SparkSession, path: str, known: DataFrame | None = None, buckets: int = BUCKETS) -> versions.Version:
    """The state before a stream begins: empty, or the sources known so far."""
    rows = spark.createDataFrame([], _STATE) if known is None else known.select(*[f.split()[0] for f in _STATE.split(", ")])
    return versions.create(rows, path, state_layout(buckets))


def read_state(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    return versions.read(spark, path, state_layout(buckets))


def apply_batch(batch: DataFrame, batch_id: int, stream: str, state: str, log: str, order: str, buckets: int = BUCKETS) -> bool:
    """Judge the documents of one micro-batch and take them into the state; false if that was done before."""
    spark, layout = batch.sparkSession, state_layout(buckets)
    before = versions.current(spark, state)
    marks = before.note.get("marks", {})
    if marks.get(stream, -1) >= batch_id:
        return False
    at = f"stream={stream}/batch_id={batch_id}"
    # numbered and hashed where the texts are read; what follows reads the other columns of the files
    texts = batch.select(*SOURCE_KEY, "content", F.col(order).alias("order"), content_hash(F.col("content")).alias("content_hash"))
    texts = texts.withColumn("text_id", F.monotonically_increasing_id())
    texts.write.mode("overwrite").option("compression", TEXT_CODEC).parquet(f"{log}/texts/{at}")
    place = F.struct("order", "text_id").alias("place")
    named = spark.read.schema(texts.schema).parquet(f"{log}/texts/{at}").select(*SOURCE_KEY, "content_hash", "text_id", place)
    fresh = last_per_key(named, SOURCE_KEY, "place").drop("place")
    touched = versions.touched(named, layout)
    known = versions.read(spark, state, layout, touched, before)
    made = F.sha2(F.concat_ws("\x1f", *SOURCE_KEY), 256)
    judged = detect_changed_hashes(fresh, known).withColumn("source_id", F.coalesce("source_id", made))
    # written before the state changes, and read again: a batch is judged once
    judged.select(*SOURCE_KEY, "source_id", "content_hash", "status", "text_id").write.mode("overwrite").parquet(f"{log}/rows/{at}")
    done = spark.read.parquet(f"{log}/rows/{at}").select(*[f.split()[0] for f in _STATE.split(", ")])
    others = salted_join(known, done.select(*SOURCE_KEY), SOURCE_KEY, "left_anti")
    versions.replace(others.unionByName(done), state, layout, touched, before, {**before.note, "marks": {**marks, stream: batch_id}})
    return True


def start_change_detection(
    stream: DataFrame,
    state: str,
    log: str,
    checkpoint: str,
    order: str = "row_index",
    buckets: int = BUCKETS,
    available_now: bool = True,
) -> StreamingQuery:
    """Judge each micro-batch of documents (source key, content, ``order``) against all before it; the running query.

    Of several texts of a source in one batch the last by ``order`` counts (one without order only if all are).
    One stream writes a state.
    """
    name = stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, name, state, log, order, buckets)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def judged_documents(spark: SparkSession, log: str, state: str, columns: Sequence[str] = (*SOURCE_KEY, "source_id", "content_hash", "status")) -> DataFrame:
    """The documents of all batches that the state knows, with their status; ``batch_id`` counts from 0.

    ``content`` may be one of the columns; the texts are joined for it.
    """
    rows = spark.read.option("basePath", f"{log}/rows").parquet(f"{log}/rows")
    finished = F.lit(False)
    for stream, last in versions.current(spark, state).note.get("marks", {}).items():
        finished = finished | (F.col("stream") == stream) & (F.col("batch_id") <= last)
    rows = rows.where(finished)
    if "content" in columns:
        texts = spark.read.option("basePath", f"{log}/texts").parquet(f"{log}/texts").where(finished)
        rows = rows.join(texts.select("stream", "batch_id", "text_id", "content"), ["stream", "batch_id", "text_id"])
    return rows.select("stream", F.col("batch_id").cast("long").alias("batch_id"), *columns)

"""Analysis of the model-run log."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.functions import blocks
from shelfline.operators.filters import equals, paginate
from shelfline.operators.scale import HotKeys, salted_join

#: Bytes of a file that a task hashes at once.
HASHED_AT_ONCE = 8 << 20

# fixed values: status -> statuses that may follow
TRANSITIONS = {
    "pending": ("running", "archived"),
    "running": ("success", "failed", "archived"),
    "success": ("archived",),
    "failed": ("archived",),
    "archived": (),
}
RUN_KEY = ("config_hash", "store_id", "product_id", "data_window_start", "data_window_end")
# events of one run that one task handles at a time


def list_runs(
    runs: DataFrame,
    page: int = 1,
    size: int = 20,
    model_type: str | None = None,
    status: str | None = None,
    store_id: int | None = None,
    product_id: int | None = None,
) -> DataFrame:
    """A page of the filtered log, newest first."""
    wanted = equals(runs, model_type=model_type, status=status, store_id=store_id, product_id=product_id)
    return paginate(wanted, ["-created_at", "run_id"], page, size)


def config_hash(config: dict[str, Any]) -> str:
    """First 16 hex digits of the SHA-256 of the config as JSON with sorted keys."""
    text = json.dumps(config, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def config_hash_column(config: Column) -> Column:
    """``config_hash`` of a map column whose values are JSON fragments (``7``, ``"naive"``)."""
    entries = F.array_sort(F.map_entries(config))
    quoted = lambda k: F.to_json(F.array(k))
    fields = F.transform(
        entries,
        lambda e: F.concat(
            quoted(e["key"]).substr(F.lit(2), F.length(quoted(e["key"])) - 2), F.lit(": "), F.coalesce(e["value"], F.lit("null"))
        ),
    )
    text = F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}"))
    return F.substring(F.sha2(text, 256), 1, 16)


def duplicate_groups(runs: DataFrame, key: Sequence[str] = RUN_KEY) -> DataFrame:
    """Keys with more than one run that is not archived, their size and their first run."""
    first = F.min(F.struct("created_at", "run_id"))
    return (
        runs.where(F.col("status") != "archived")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("runs"), first.alias("_first"))
        .where(F.col("runs") > 1)
        .select(*key, "runs", F.col("_first.run_id").alias("first_run_id"))
    )


def apply_duplicate_policy(runs: DataFrame, policy: str, key: Sequence[str] = RUN_KEY) -> DataFrame:
    """``allow`` keeps all runs, ``deny`` drops repeats, ``detect`` names the run each repeats.

    Of equal runs the earliest one stays; archived runs neither repeat nor are repeated.
    """
    if policy not in ("allow", "deny", "detect"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "allow":
        return runs
    groups = duplicate_groups(runs, key).drop("runs")
    marked = salted_join(runs, groups, list(key), "left", spread=["run_id"])
    repeats = (
        (F.col("status") != "archived")
        & F.col("first_run_id").isNotNull()
        & (F.col("first_run_id") != F.col("run_id"))
    )
    if policy == "deny":
        return marked.where(~repeats).drop("first_run_id")
    return marked.withColumn("duplicate_of", F.when(repeats, F.col("first_run_id"))).drop("first_run_id")


def transition_audit(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Each status change (run_id, status, at) with the status before it and whether it is allowed.

    The first status of a run has to be pending.  A run has a handful of events, so one window by run
    does; for a log in which a broken writer floods a run, ``block_rows`` cuts it into blocks.
    """
    entity = ["run_id"]
    if block_rows is None:
        rows = events.withColumn("from_status", F.lag("status").over(Window.partitionBy(*entity).orderBy("at")))
    else:
        rows = blocks.with_halo(blocks.with_row_index(events, entity, "at"), 1, block_rows)
        before = F.lag("status").over(blocks.block_window(entity, "at"))
        rows = blocks.drop_halo(rows.withColumn("from_status", before))
    allowed = F.col("from_status").isNull() & (F.col("status") == "pending")
    for start, ends in TRANSITIONS.items():
        if ends:
            allowed = allowed | ((F.col("from_status") == start) & F.col("status").isin(list(ends)))
    return rows.withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def _paired(pairs: DataFrame, runs: DataFrame, column: str) -> DataFrame:
    """Pairs (run_a, run_b) with both values of a map column; pairs with an unknown run drop out."""
    a = runs.select(F.col("run_id").alias("run_a"), F.col(column).alias("_a"))
    b = runs.select(F.col("run_id").alias("run_b"), F.col(column).alias("_b"))
    # one run may be compared with very many others
    measure = HotKeys(pairs, "run_a", "run_b")
    first = salted_join(pairs.select("run_a", "run_b"), a, ["run_a"], spread=["run_b"], measure=measure)
    return salted_join(first, b, ["run_b"], spread=["run_a"], measure=measure)


def _keyed(paired: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    keys = F.array_union(empty("_a"), empty("_b"))
    return paired.withColumn("key", F.explode(keys)).select(
        "run_a", "run_b", "key", F.col("_a")[F.col("key")].alias("a"), F.col("_b")[F.col("key")].alias("b")
    )


def config_diff(pairs: DataFrame, runs: DataFrame, column: str = "config") -> DataFrame:
    """Config keys whose values differ, with both values."""
    return _keyed(_paired(pairs, runs, column)).where(~F.col("a").eqNullSafe(F.col("b")))


def metric_diff(pairs: DataFrame, runs: DataFrame, column: str = "metrics") -> DataFrame:
    """All metrics of either run with ``b - a`` where both are known."""
    return _keyed(_paired(pairs, runs, column)).withColumn("diff", F.col("b") - F.col("a"))


def alias_table(assignments: DataFrame, runs: DataFrame) -> DataFrame:
    """The run each alias points to: the latest assignment (alias_name, run_id, at) to a successful run."""
    good = runs.where(F.col("status") == "success").select("run_id")
    usable = assignments.join(good, "run_id", "left_semi")
    return usable.groupBy("alias_name").agg(
        F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"), F.max("at").alias("updated_at")
    )


def resolve_aliases(aliases: DataFrame, runs: DataFrame, alias_name: str | None = None) -> DataFrame:
    """Aliases with status and model of their run."""
    wanted = equals(aliases, alias_name=alias_name)
    return wanted.join(
        runs.select("run_id", F.col("status").alias("run_status"), "model_type"), "run_id"
    )


def open_artifact(path: str) -> BinaryIO:
    """A stream over a file by its full path; stores are those that Arrow knows."""
    local = re.fullmatch("(?:file:(?://)?)?(/.*)", path, re.DOTALL)
    store, inside = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)
    return store.open_input_stream(inside, compression=None)


def file_hashes(paths: DataFrame, opener: Callable[[str], BinaryIO] = open_artifact, piece: int = HASHED_AT_ONCE) -> DataFrame:
    """``path, file_hash`` for rows of ``path``: SHA-256 of files of any size, NULL where there is none.

    A task holds ``piece`` bytes at a time.  ``opener`` runs in the tasks and raises ``FileNotFoundError`` for a
    file that is missing; pass another one for a store that Arrow does not reach.
    """

    def hashed(path: str) -> str | None:
        said = hashlib.sha256()
        try:
            with opener(path) as stream:
                while part := stream.read(piece):
                    said.update(part)
        except FileNotFoundError:
            return None
        return said.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [None if path is None else hashed(path) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string())], ["path", "file_hash"])

    return paths.select("path").mapInArrow(run, "path string, file_hash string")


def verify_artifacts(spark: SparkSession, runs: DataFrame, folder: str, opener: Callable[[str], BinaryIO] = open_artifact) -> DataFrame:
    """Stored hash of each run's artifact against the file: ok, mismatch or missing.

    ``artifact_uri`` is the path below ``folder``; one that leaves it is missing.  The distinct names are dealt to
    the tasks, which read the files piece by piece where they lie: their size does not matter, and nothing else in
    the folder is listed.
    """
    if not re.match("[A-Za-z][A-Za-z0-9+.-]*:", folder):
        store = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
        folder = os.path.abspath(folder) if store.startswith("file:") else f"{store.rstrip('/')}/{folder.lstrip('/')}"
    outside = F.col("artifact_uri").rlike("(^/)|((^|/)[.][.](/|$))")
    path = F.when(~outside, F.concat(F.lit(folder.rstrip("/") + "/"), "artifact_uri")).alias("path")
    wanted = runs.select("artifact_uri").distinct().select(path)
    start = len(folder.rstrip("/")) + 2
    files = file_hashes(wanted.repartition("path"), opener).select(F.expr(f"substring(path, {start})").alias("artifact_uri"), "file_hash")
    status = (
        F.when(F.col("file_hash").isNull(), "missing")
        .when(F.col("file_hash") == F.col("artifact_hash"), "ok")
        .otherwise("mismatch")
    )
    return runs.join(files, "artifact_uri", "left").withColumn("verification", status)

"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one of labelled good documents (the target), one of
all documents (the raw text).  The log ratio of their probabilities, averaged over a document's n-grams,
is its importance; with Gumbel noise added, taking the k largest keys samples k documents without
replacement in proportion to their importance.  k is given, or estimated: as many documents as lie above the
importance that parts the labels best, on labelled documents that the target model has not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import bytes_of, cut, free_names, hash_sample, kth_largest, stored, text_of, uniform

BUCKETS = 1 << 14
#: Labelled documents that are used at most, half for the target model and half for the cut.
LABELLED = 20_000
#: The mean log ratio counts as often as this many n-grams would, so that length alone decides nothing.
SHARPNESS = 50.0
#: Counts per bucket, on average, by which the target model leans on the raw one.
PRIOR = 1.0
BATCH = 2 << 20

_RANDOM = np.random.default_rng(20240601)
_TABLE = _RANDOM.integers(0, 1 << 63, (64, 256), dtype=np.uint64)
_AGAIN, _PAIR, _MIX = (np.uint64(x | 1) for x in _RANDOM.integers(0, 1 << 63, 3, dtype=np.uint64))


def _classes() -> np.ndarray:
    """0: between tokens, 1: letters, digits and all bytes beyond ASCII, 2: other printable characters."""
    out = np.zeros(256, np.uint8)
    out[33:127] = 2
    out[128:] = 1
    for c in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[c] = 1
    return out


_CLASS = _classes()
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def ngrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of the rows, and the row of each.

    A token is a run of letters and digits or a run of punctuation, in lower case; one that repeats the
    token before it becomes one and the same symbol.  Bigrams stay within a row.
    """
    kind = _CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[at[:-1][at[:-1] < len(data)]] = True
    edges = np.append(np.flatnonzero(first), len(data))
    starts = edges[:-1][kind[edges[:-1]] > 0] if len(data) else edges[:0]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = (np.arange(len(data)) - np.repeat(edges[:-1], np.diff(edges))) & 63
    runs = np.add.reduceat(_TABLE[place, _LOWER[data]], edges[:-1])
    token = runs[kind[edges[:-1]] > 0]
    row = np.searchsorted(at, starts, "right") - 1
    same_row = row[1:] == row[:-1]
    again = np.zeros(len(token), bool)
    again[1:] = (token[1:] == token[:-1]) & same_row
    token[again] = _AGAIN
    pairs = (token[:-1] * _PAIR + token[1:])[same_row]
    grams = np.concatenate([token, pairs]) * _MIX
    return (grams >> np.uint64(50)).astype(np.int64), np.concatenate([row, row[1:][same_row]])


@dataclass(frozen=True)
class Model:
    """Log ratio of target to raw probability by bucket, and the least key that is kept."""

    ratio: np.ndarray
    cut: float = -math.inf


def labelled_sample(labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """``id, good, fit``: at most ``rows`` documents whose labels agree, picked by a hash of the id."""
    labels = labels.select(labels["doc_id"].alias("id"), labels["quality"].cast("int").alias("q")).where("id is not null and q is not null")
    agreed = labels.groupBy("id").agg(F.min("q").alias("q"), F.max("q").alias("_most")).where("q = _most")
    picked = hash_sample(agreed, ["id"], rows)
    return picked.select("id", (F.col("q") > 0).alias("good"), (F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)) == 0).alias("fit"))


def fit_ratio(documents: DataFrame, sample: DataFrame) -> np.ndarray:
    """Count both models over all documents; only sums by bucket leave the tasks."""
    target = sample.where("good and fit").select("id", F.lit(True).alias("target"))
    text = documents.select(documents["doc_id"].alias("id"), text_of(documents).alias("text"))
    # the sample is bounded by its limit
    text = text.join(F.broadcast(target), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in cut(whole, BATCH):
                bucket, row = ngrams(*bytes_of(batch.column("text")))
                raw += np.bincount(bucket, minlength=BUCKETS)
                flags = batch.column("target").to_numpy(zero_copy_only=False)
                if flags.any():
                    good += np.bincount(bucket[flags[row]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(good)], ["bucket", "raw", "good"])

    counted = text.mapInArrow(count, "bucket long, raw long, good long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:  # one row per bucket
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    p = (raw + 1e-3) / (raw.sum() + 1e-3 * BUCKETS)
    q = (good + PRIOR * BUCKETS * p) / (good.sum() + PRIOR * BUCKETS)
    return np.log(q) - np.log(p)


def scored(documents: DataFrame, ratio: np.ndarray, seed: int = 0, sharpness: float = SHARPNESS, prefix: str = "") -> DataFrame:
    """All columns, and ``n_grams, importance`` (mean log ratio; 0 without n-grams) and ``key`` with Gumbel noise."""
    names = free_names(documents, *(prefix + n for n in ("n_grams", "importance", "key")))
    text, ident = free_names(documents, "scored_text", "scored_id")
    rows = documents.withColumn(text, text_of(documents))
    rows = rows.withColumn(ident, F.xxhash64(F.lit(seed), documents["doc_id"], documents["text"]))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in documents.schema)}, {names[0]} long, {names[1]} double, {names[2]} double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, BATCH):
                bucket, row = ngrams(*bytes_of(batch.column(batch.num_columns - 2)))
                n = np.bincount(row, minlength=batch.num_rows)
                total = np.bincount(row, ratio[bucket], minlength=batch.num_rows)
                mean = total / np.maximum(n, 1)
                noise = -np.log(-np.log(uniform(batch.column(batch.num_columns - 1).to_numpy())))
                out = [*batch.columns[:-2], pa.array(n.astype(np.int64)), pa.array(mean), pa.array(mean * sharpness + noise)]
                yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-2], *names])

    return rows.mapInArrow(work, schema)


def best_cut(values: np.ndarray, good: np.ndarray) -> float:
    """The value in the middle of the gap that parts good from bad with the fewest mistakes (shares by class)."""
    if not good.any() or good.all():
        return float(values.min()) if len(values) and good.all() else -math.inf
    order = np.argsort(values, kind="stable")
    values, good = values[order], good[order]
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    let_in = 1 - np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    wrong = lost + let_in
    best = np.flatnonzero(wrong == wrong.min())
    at = best[len(best) // 2]
    low = values[at - 1] if at else -math.inf
    high = values[at] if at < len(values) else math.inf
    return float((low + high) / 2) if math.isfinite(low) and math.isfinite(high) else float(high if at == 0 else low)


def importance_cut(documents: DataFrame, sample: DataFrame, ratio: np.ndarray) -> float:
    """The importance that parts the labelled documents kept from the target model; one row per id is collected."""
    held = documents.select("doc_id", "text").join(F.broadcast(sample.where("not fit")), documents["doc_id"] == F.col("id"))
    rated = scored(held, ratio)
    # documents that share an id count with their mean
    found = rated.groupBy("id").agg(F.avg("importance").alias("importance"), F.max("good").alias("good")).toPandas()
    return best_cut(found["importance"].to_numpy(float), found["good"].to_numpy(bool))


def drawn(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, rows: int = LABELLED) -> tuple[Model, DataFrame]:
    """The model with the k-th largest key, and the stored ``doc_id, n_grams, importance, key`` of all documents."""
    sample = labelled_sample(labels, rows)
    ratio = fit_ratio(documents, sample)
    keys = stored(scored(documents.select("doc_id", "text"), ratio, seed).drop("text"), "quality-keys")
    if k is None:
        k = keys.where(F.col("importance") >= F.lit(importance_cut(documents, sample, ratio))).count()
    return Model(ratio, kth_largest(keys, "key", k)), keys


def classify(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """``doc_id, n_grams, importance, key, kept`` for every document; the ``k`` with the largest keys are kept.

    Without ``k`` it is estimated, see ``drawn``.  Whole texts are scored.  Null texts count as empty; a
    document without n-grams has importance 0 and is decided by its noise.  Null ids are scored, but no label
    applies to them.  Repeated rows get the same key, and documents that tie with the k-th key all stay.
    Contradicting labels are left out; with no labels, or none of bad documents, all documents down to the worst
    good one count for ``k``, or all.  An empty table gives no rows.  Other columns are ignored.
    """
    model, keys = drawn(documents, labels, k, seed)
    return keys.select("doc_id", "n_grams", "importance", "key", (F.col("key") >= F.lit(model.cut)).alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """The documents that ``classify`` keeps, with all their columns.

    Repeated rows stay or go together; an empty table gives no rows; columns of any name stay as they are.
    """
    model, _ = drawn(documents, labels, k, seed)
    rows = scored(documents, model.ratio, seed)
    return rows.where(F.col(rows.columns[-1]) >= F.lit(model.cut)).select(*documents.columns)

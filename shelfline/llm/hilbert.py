"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few dimensions, several times in other directions and with other shifts, and
ordered along a Hilbert curve each time.  Spark range-partitions the orderings and numbers the rows; a
query is compared exactly with the rows within a window of its place on every curve, and the windows merge.
The cells of a direction are cut at quantiles, and the few longest vectors meet every query beside the curves,
so vectors of very uneven lengths do not fall into few cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import hash_sample, stored
from shelfline.llm.graph import group_starts, sorted_groups
from shelfline.llm.vectors import matrix, packed, prepared, unpacked
from shelfline.operators.scale import global_row_number, salted_join

K = 20
CURVES = 8
DIMENSIONS, BITS = 8, 6
#: Rows on either side of a query, as a share of all distinct vectors, and at least so many.
WINDOW, LEAST_WINDOW = 0.11, 512
#: So many longest vectors are held against every query, beside the curves.
LONGEST = 256
#: Distinct vectors on which the borders of the cells are fitted; every vector is indexed.
SAMPLE, BORDERS = 16_384, 256
#: Rows of an ordering that one task compares at once.
BLOCK = 4096
#: Finds that a task holds before it merges and passes them on.
HELD = 1 << 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by Skilling's transpose."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Projections:
    """For each curve: orthogonal directions and a shift; blocks of one random rotation are used up in turn."""

    def __init__(self, size: int, curves: int, dimensions: int = DIMENSIONS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dimensions = min(dimensions, size + 1)
        directions: list[np.ndarray] = []
        while len(directions) < curves * self.dimensions:
            rotation, _ = np.linalg.qr(rng.normal(size=(size + 1, size + 1)))
            whole = len(rotation) // self.dimensions * self.dimensions
            directions += list(rotation[:whole])
        self.directions = np.array(directions[: curves * self.dimensions]).T
        self.shifts = rng.random(curves * self.dimensions)

    def points(self, rows: np.ndarray, length: float) -> np.ndarray:
        """Projections of vectors on a unit half sphere: there, near points have large inner products with a query.

        A component is added that fills every vector up to ``length``; longer ones get none.  It is counted
        from the pole, which moves all points alike, so that short vectors keep their digits.
        """
        rows = rows / length
        square = np.minimum(1.0, np.einsum("ij,ij->i", rows, rows))
        missing = -square / (1 + np.sqrt(1 - square))
        return np.concatenate([rows, missing[:, None]], axis=1) @ self.directions

    def keys(self, points: np.ndarray, borders: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
        """A key for each curve: cells hold equal shares of the vectors; the shifted box is twice as wide."""
        share = np.linspace(0, 1, len(borders))
        place = np.stack([np.interp(points[:, i], borders[:, i], share) for i in range(points.shape[1])], axis=1)
        cells = np.clip((place + self.shifts) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
        d = self.dimensions
        return [hilbert_keys(cells[:, i : i + d], bits) for i in range(0, cells.shape[1], d)]


def _norm() -> Column:
    """The length of a vector; the components are scaled first, so that no square overflows."""
    most = F.array_max(F.transform("vector", F.abs))
    return most * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))


def longest_vectors(reps: DataFrame, size: int, n: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``node, least, vector`` of the ``n`` longest vectors, and the length of the longest of all others."""
    first = reps.select("node", "least", "vector", _norm().alias("norm")).orderBy(F.desc("norm"), "least", "node").limit(n + 1).toArrow()
    rows = matrix(first.column("vector"), size)
    node, least = (first.column(c).to_numpy()[:n] for c in ("node", "least"))
    return node, least, rows[:n], float(first.column("norm")[-1].as_py())


def beside_curves(reps: DataFrame, longest: tuple[np.ndarray, np.ndarray, np.ndarray, float], size: int, k: int) -> DataFrame:
    """``query, node, least, score``: the best ``k`` of the longest vectors for every query."""
    node, least, rows, _ = longest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield from _batches(_top([_nearest(part.column("node").to_numpy(), matrix(part.column("vector"), size), node, least, rows, k)], k))

    return reps.where("asks").select("node", "vector").mapInArrow(work, "query long, node long, least long, score double")


def cell_borders(reps: DataFrame, projections: Projections, size: int, length: float, count: int) -> np.ndarray:
    """Quantiles of the projections in each direction, from a sample picked by hash."""
    sample = hash_sample(reps, ["h1", "h2"], SAMPLE, count).select("vector").toArrow()
    return np.quantile(projections.points(matrix(sample.column("vector"), size), length), np.linspace(0, 1, BORDERS + 1), axis=0)


def orderings(reps: DataFrame, projections: Projections, size: int, count: int, length: float) -> DataFrame:
    """``curve, node, rank``: all ``count`` vectors on all curves, numbered from 0 along each.

    Equal keys are in another order on every curve.
    """
    borders = cell_borders(reps, projections, size, length, count)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = projections.points(matrix(batch.column("vector"), size), length)
                for curve, key in enumerate(projections.keys(points, borders)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), curve, np.int32)), pa.array(key), batch.column("node")], ["curve", "key", "node"])

    keyed = reps.select("node", "vector").mapInArrow(work, "curve int, key long, node long")
    numbered = global_row_number(keyed, [F.col("curve"), F.col("key"), F.xxhash64("curve", "node"), F.col("node")], "all")
    return numbered.select("curve", "node", (F.col("all") - 1 - F.col("curve") * F.lit(count)).alias("rank"))


def windows(reps: DataFrame, ranked: DataFrame, window: int, count: int) -> DataFrame:
    """Candidates (role 0) in their block of a curve, queries (role 1) in all blocks that their window meets."""
    rows = ranked.join(reps.select("node", "least", "asks", "vector"), "node")

    def block(by: int) -> Column:
        return F.floor(F.least(F.lit(count - 1), F.greatest(F.lit(0), F.col("rank") + by)) / BLOCK)

    places = F.array(F.struct(block(0).alias("block"), F.lit(0).alias("role")))
    asked = F.transform(F.sequence(block(-window), block(window)), lambda b: F.struct(b.alias("block"), F.lit(1).alias("role")))
    rows = rows.withColumn("p", F.explode(F.when(F.col("asks"), F.concat(places, asked)).otherwise(places)))
    rows = rows.select("curve", F.col("p.block").alias("block"), F.col("p.role").alias("role"), "node", "least", "rank", "vector")
    # blocks in a row go to one task as a rule, where the finds of a query's window are merged
    return rows.repartitionByRange("curve", "block").sortWithinPartitions("curve", "block", "role")


def merged(dealt: DataFrame, beside: DataFrame, size: int, window: int, k: int) -> DataFrame:
    """``query, node, least, score``: the best ``k`` of each query in each block, then over all blocks, curves and ``beside``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, curve = [], None
        for columns in sorted_groups(_flat(batches), 2):
            starts = np.append(group_starts(columns[:2]), len(columns[0]))
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if curve != columns[0][s] or sum(len(h[0]) for h in held) > HELD:
                    yield from _batches(_top(held, k))
                    held, curve = [], columns[0][s]
                held += _best([c[s:e] for c in columns], size, window, k)
        yield from _batches(_top(held, k))

    found = dealt.mapInArrow(work, "query long, node long, least long, score double")
    found = found.unionByName(beside).groupBy("query", "node", "least").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least", "node")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as binary values, which can be cut and joined like numbers."""
    for batch in batches:
        if batch.num_rows:
            vector = batch.column("vector")
            width = len(vector.flatten()) // batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed(matrix(vector, width))], batch.schema.names)


def _best(columns: list[np.ndarray], size: int, window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Query, node, least id and score of the best of a block, for some hundred queries at a time."""
    _, _, role, node, least, rank, vector = columns
    n = int((role == 0).sum())
    if not n or n == len(role):
        return
    rows = unpacked(vector, np.float64, size)
    for at in range(n, len(role), 512):
        to = min(at + 512, len(role))
        far = np.abs(rank[at:to, None] - rank[:n]) > window
        yield from _top([_nearest(node[at:to], rows[at:to], node[:n], least[:n], rows[:n], k, far)], k)


def _nearest(query: np.ndarray, asked: np.ndarray, node: np.ndarray, least: np.ndarray, rows: np.ndarray, k: int, far: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Query, node, least id and exact score of all candidates that may be among the best ``k`` of a query, ties included."""
    score = asked @ rows.T
    # the product of matrices may round otherwise than the exact score
    length = np.sqrt(np.einsum("ij,ij->i", asked, asked))[:, None] * np.sqrt(np.einsum("ij,ij->i", rows, rows).max())
    if far is not None:
        score[far] = -np.inf
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, [score.shape[1] - k]] if score.shape[1] > k else np.full((len(score), 1), -np.inf)
    slack = 1e-15 * rows.shape[1] * length
    q, c = np.nonzero((score >= kth - np.where(np.isfinite(slack), slack, 0)) & (score > -np.inf))
    return query[q], node[c], least[c], np.einsum("ij,ij->i", asked[q], rows[c])


def _top(found: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """The best ``k`` of each query; on one curve, no block holds a candidate of another."""
    if not found:
        return []
    query, node, least, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((node, least, -score, query))
    query, node, least, score = query[order], node[order], least[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return [(query[keep], node[keep], least[keep], score[keep])]


def _batches(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for columns in found:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "node", "least", "score"])


def search(embeddings: DataFrame, every: int = 20, k: int = K, curves: int = CURVES, window: float = WINDOW) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each id divisible by ``every``.

    Scores are exact, of the original vectors in double precision; ties go to the smaller id.  All rows
    are indexed.  Equal vectors stand once on the curves, with their ``k + 1`` smallest ids: no more of them
    can be among the nearest.  Vectors that are null, empty or zero, hold null or non-finite components or
    have another size than most, and rows without an id, take no part.  Rows with the id of a query are not
    its neighbours, and repeated rows count once.  With fewer than ``k`` other rows all are returned; an
    empty table gives no rows.  Other columns are ignored.
    """
    rows, size = prepared(embeddings)
    rows = rows.where("ok and vec_id is not null")
    copies = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = rows.groupBy("h1", "h2", "vec_id").agg(F.lit(1).alias("one"))  # repeated rows combine before the shuffle
    ids = ids.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    asks = F.max(F.col("vec_id") % every == 0)
    first = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), asks.alias("asks"), F.first("vector").alias("vector"))
    # numbered once, when written
    reps = stored(first.join(ids, ["h1", "h2"]).withColumn("node", F.monotonically_increasing_id()), "hilbert-vectors")
    count = reps.count()
    if not count:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    reach = max(LEAST_WINDOW, math.ceil(window * count))
    longest = longest_vectors(reps, size)
    ranked = orderings(reps, Projections(size, curves), size, count, longest[-1])
    best = merged(windows(reps, ranked, reach, count), beside_curves(reps, longest, size, k + 1), size, reach, k + 1)
    entries = best.join(reps.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    entries = entries.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    near = F.sort_array(F.collect_list(F.struct("r", "vec_id", "score")))  # k + 1 entries
    lists = entries.groupBy("query").agg(near.alias("near"))
    lists = lists.join(reps.select(F.col("node").alias("query"), "h1", "h2"), "query").select("h1", "h2", "near")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "h1", "h2").distinct().withColumnRenamed("vec_id", "query_id")
    out = salted_join(queries, stored(lists, "hilbert-near"), ["h1", "h2"], spread=["query_id"])
    others = F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))

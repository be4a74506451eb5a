"""Exact cosine retrieval.

A few queries go to the chunks: every task holds them and keeps its best hits, and no chunk is shuffled.  For
more of them, chunks are dealt into parts of a bounded size by their nearest pivot and the angle to it.  By the
triangle inequality of angles, a part can only hold hits of a query if the query's own angle to that pivot
allows a score that reaches the threshold and the k-th best score in a sample of the chunks; only such
parts are asked.  No pair of chunk and query is ever a row of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK = 1024
#: So many queries go to all tasks; a task then gives at most so many times k hits.
FEW = 256
#: Scores that a task computes at once, hits that it holds, and bytes of the vectors of a part.
PAIRS, HELD, PART_BYTES = 1 << 23, 1 << 16, 64 << 20
#: Pivots, chunks in the sample that they come from, and intervals of the angle to a pivot.
PIVOTS, SAMPLE, INTERVALS = 128, 4096, 256
SNIPPET_CHARS = 200


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays; NULL for a vector without length."""
    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0).cast("double"), lambda acc, x: acc + x)

    product = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda c: F.sqrt(total(F.transform(c, lambda x: x.cast("double") * x.cast("double"))))
    return F.try_divide(product, norm(a) * norm(b))


def top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 5,
    threshold: float = 0.7,
    chunk_id: str = "chunk_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    block: int = QUERY_BLOCK,
    few: int | None = None,
) -> DataFrame:
    """The ``k`` chunks nearest to each query with a similarity of at least ``threshold``.

    Equal scores are ordered by chunk id.  Rows without a vector, or with one of length zero, are skipped.
    Filter ``chunks`` beforehand to search a part of the table.  Chunks are read once for up to ``few`` queries; for
    more they are counted first, and a query meets the parts that may hold its hits, ``block`` queries at a time.
    """
    few = FEW if few is None else few
    kind = {"q": queries.schema[query_id].dataType, "c": chunks.schema[chunk_id].dataType}
    arrow = {name: _arrow(t) for name, t in kind.items()} | {"score": pa.float64()}
    schema = T.StructType([T.StructField("q", kind["q"]), T.StructField("c", kind["c"]), T.StructField("score", T.DoubleType())])
    values = F.col(vector).cast("array<double>").alias("v")
    stock = chunks.where(F.col(vector).isNotNull()).select(F.col(chunk_id).alias("c"), values)
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("q"), values)
    first = asked.limit(few + 1).toArrow()
    if first.num_rows <= few:
        found = stock.mapInArrow(_few_queries(first, k, threshold, arrow), schema)
    else:
        found = _by_parts(stock, asked, k, threshold, block, arrow, schema)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("q").alias(query_id), "rank", F.col("c").alias(chunk_id), F.round("score", 4).alias("relevance_score"))
    )


def _few_queries(queries: pa.Table, k: int, threshold: float, arrow: dict):
    """Tasks that score all queries against their chunks and give the best of each."""
    batches = queries.combine_chunks().to_batches()
    names, asked = _unit(batches[0], "q") if batches else (np.zeros(0, object), np.zeros((0, 0)))
    step = PAIRS // max(1, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Hits(names, k)
        for batch in batches if len(names) else ():
            for at in range(0, batch.num_rows, step):
                ids, table = _unit(batch.slice(at, step), "c")
                best.add(_scores(asked, table), ids, threshold)
        yield best.batch(arrow)

    return run


class _Hits:
    """The best ``k`` hits of some queries so far."""

    def __init__(self, names: np.ndarray, k: int):
        self.names, self.k, self.held, self.found = names, k, 0, []

    def add(self, scores: np.ndarray, ids: np.ndarray, threshold: float) -> None:
        """Take in a matrix of queries x chunks."""
        least = np.full((len(scores), 1), threshold)
        if scores.shape[1] > self.k:
            # all scores that tie with the k-th stay until the ids decide
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, [scores.shape[1] - self.k]])
        q, c = np.nonzero(scores >= least)
        self.found.append((q, ids[c], scores[q, c]))
        self.held += len(q)
        if self.held > HELD:
            self._cut()

    def _cut(self) -> None:
        q, c, score = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((np.unique(c, return_inverse=True)[1], -score, q))
        q, c, score = q[order], c[order], score[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.found, self.held = [(q[first], c[first], score[first])], 0

    def batch(self, arrow: dict) -> pa.RecordBatch:
        if not self.found:
            return pa.RecordBatch.from_arrays([pa.nulls(0, t) for t in arrow.values()], list(arrow))
        self._cut()
        q, c, score = self.found[0]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((self.names[q], c, score), arrow.values())], list(arrow))


# -- parts --------------------------------------------------------------------


def _by_parts(stock: DataFrame, asked: DataFrame, k: int, threshold: float, block: int, arrow: dict, schema: T.StructType) -> DataFrame:
    """``q, c, score``: at most ``k`` hits of each query in each part that may hold one."""
    spark = stock.sparkSession
    pivots, sample = _pivots(stock)
    if not len(pivots):
        return spark.createDataFrame([], schema)
    width = pivots.shape[1]
    placed = stock.mapInArrow(_place(pivots), T.StructType([*stock.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("slot", T.IntegerType())]))
    counts = placed.groupBy("pivot", "slot").agg(F.count(F.lit(1)).alias("n")).collect()  # at most pivots x intervals rows
    parts = _parts([(r["pivot"], r["slot"], r["n"]) for r in counts], max(1, PART_BYTES // (8 * width)))
    slots = spark.createDataFrame([(p, s, first, pieces) for p, s, first, pieces, _, _ in parts], "pivot int, slot int, first long, pieces long")
    part = (F.col("first") + F.pmod(F.xxhash64("c"), F.col("pieces"))).alias("part")
    none = {f.name: F.lit(None).cast(f.dataType) for f in schema}
    dealt = placed.join(F.broadcast(slots), ["pivot", "slot"]).select(part, F.lit(0).alias("role"), none["q"].alias("q"), "c", "v")
    wanted = T.StructType([T.StructField("part", T.LongType()), T.StructField("role", T.IntegerType()), *[f for f in schema.fields[:2]], stock.schema["v"]])
    meets = asked.mapInArrow(_choose(pivots, sample, parts, k, threshold, arrow), wanted)
    both = dealt.unionByName(meets).repartitionByRange("part").sortWithinPartitions("part", "role")
    return both.mapInArrow(_meet(k, threshold, block, arrow), schema)


def _pivots(stock: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors far from each other, and the bounded sample, picked by hash, that they come from."""
    sized = stock.where(F.exists("v", lambda x: x != 0)).withColumn("_h", F.xxhash64("c", "v"))
    batches = sized.orderBy("_h").limit(SAMPLE).select("c", "v").toArrow().combine_chunks().to_batches()
    if not batches:
        return np.zeros((0, 0)), np.zeros((0, 0))
    _, sample = _unit(batches[0], "c")
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(PIVOTS, len(sample)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen], sample


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_scores(rows, pivots), -1, 1))


def _place(pivots: np.ndarray):
    """The nearest pivot of each chunk, and the interval of the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, rows = _lengths(batch)
            batch, rows = batch.filter(pa.array(norms > 0)), rows[norms > 0] / norms[norms > 0, None]
            angles = _angles(rows, pivots)
            pivot = angles.argmin(axis=1)
            slot = np.minimum(INTERVALS - 1, angles.min(axis=1) / np.pi * INTERVALS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(slot)], [*batch.schema.names, "pivot", "slot"])

    return run


def _parts(counts: list[tuple[int, int, int]], rows: int) -> list[tuple[int, int, int, int, float, float]]:
    """``pivot, slot, first part, pieces, least and greatest angle of the part`` for each occupied slot.

    Slots of a pivot share a part while they have at most ``rows`` together; a larger one is cut into pieces.
    """
    out, group, size, number = [], [], 0, 0

    def close() -> None:
        nonlocal group, size, number
        if group:
            pieces = -(-size // rows)
            low, high = group[0][1] * np.pi / INTERVALS, (group[-1][1] + 1) * np.pi / INTERVALS
            out.extend((p, s, number, pieces, low, high) for p, s in group)
            number += pieces
        group, size = [], 0

    for pivot, slot, n in sorted(counts):
        if group and (group[0][0] != pivot or size + n > rows):
            close()
        group.append((pivot, slot))
        size += n
    close()
    return out


def _choose(pivots: np.ndarray, sample: np.ndarray, parts: list, k: int, threshold: float, arrow: dict):
    """A row of a query for each part that may hold one of its hits."""
    ranges = sorted({(first, pieces, p, low, high) for p, _, first, pieces, low, high in parts})
    first, pieces, pivot = (np.array([r[i] for r in ranges], np.int64) for i in range(3))
    low, high = (np.array([r[i] for r in ranges]) for i in (3, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, rows = _lengths(batch)
            batch, rows = batch.filter(pa.array(norms > 0)), rows[norms > 0] / norms[norms > 0, None]
            for at in range(0, len(rows), 256):
                some, near = batch.slice(at, 256), rows[at : at + 256]
                least = np.full(len(near), threshold)
                if len(sample) >= k:
                    least = np.maximum(least, np.partition(_scores(near, sample), len(sample) - k, axis=1)[:, len(sample) - k])
                angles = _angles(near, pivots)[:, pivot]
                gap = np.maximum(0, np.maximum(angles - high, low - angles) - 1e-7)
                q, r = np.nonzero(np.cos(gap) >= least[:, None] - 1e-9)
                each = pieces[r]
                q, part = np.repeat(q, each), np.repeat(first[r], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                taken = some.take(pa.array(q))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.ones(len(q), np.int32)), taken.column("q"), pa.nulls(len(q), arrow["c"]), taken.column("v")],
                    ["part", "role", "q", "c", "v"],
                )

    return run


def _meet(k: int, threshold: float, block: int, arrow: dict):
    """Tasks that hold the chunks of a part and score its queries against them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            key = batch.column("part").to_numpy() * 2 + batch.column("role").to_numpy()
            edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else []
            for start, end in zip(edges, [*edges[1:], len(key)]):
                piece = batch.slice(start, end - start)
                if key[start] // 2 != part:
                    part, held = key[start] // 2, []
                if key[start] % 2 == 0:
                    held.append(_unit(piece, "c"))
                elif held:
                    if len(held) > 1:
                        held = [(np.concatenate([h[0] for h in held]), _stack([h[1] for h in held]))]
                    ids, table = held[0]
                    names, matrix = _unit(piece, "q")
                    step = max(1, min(block, PAIRS // max(1, len(ids))))
                    for at in range(0, len(names), step):
                        best = _Hits(names[at : at + step], k)
                        best.add(_scores(matrix[at : at + step], table), ids, threshold)
                        yield best.batch(arrow)

    return run


def _lengths(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The length of each vector, and the vectors."""
    vectors = rows.column("v")
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("all vectors must have the same number of values")
    table = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
    return np.linalg.norm(table, axis=1), table


def _unit(rows: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows whose vector has a length."""
    norms, table = _lengths(rows)
    some = norms > 0
    return rows.column(name).to_numpy(zero_copy_only=False)[some], table[some] / norms[some, None]


def _stack(tables: list[np.ndarray]) -> np.ndarray:
    tables = [t for t in tables if len(t)] or tables[:1]
    if len({t.shape[1] for t in tables}) > 1:
        raise ValueError("all vectors must have the same number of values")
    return np.concatenate(tables)


def _scores(matrix: np.ndarray, table: np.ndarray) -> np.ndarray:
    if len(table) and matrix.shape[1] != table.shape[1]:
        raise ValueError(f"chunk vectors must have {matrix.shape[1]} values")
    return matrix @ table.T if len(table) else np.zeros((len(matrix), 0))


def _arrow(kind: T.DataType) -> pa.DataType:
    known = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64(),
    }
    if type(kind) not in known:
        raise TypeError(f"ids must be int, long or string, not {kind.simpleString()}")
    return known[type(kind)]


def citations(hits: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Hits with source, relevance to two digits and the first 200 characters of their text."""
    text = F.col("content")
    snippet = F.when(
        F.char_length(text) > SNIPPET_CHARS, F.concat(F.substring(text, 1, SNIPPET_CHARS), F.lit("..."))
    ).otherwise(text)
    about = chunks.select(chunk_id, "source_type", "source_path", "content")
    return hits.join(about, chunk_id).select(
        "query_id", "rank", chunk_id, "source_type", "source_path",
        F.format_string("%.2f", F.floor(F.col("relevance_score") * 100 + 0.5) / 100).alias("relevance"), snippet.alias("snippet"),
    )


def sufficient_evidence(
    hits: DataFrame, queries: DataFrame, min_results: int = 1, min_relevance: float = 0.7
) -> DataFrame:
    """Per query: number of hits, mean relevance and whether both reach their minimum."""
    found = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("results"), F.avg("relevance_score").alias("mean_relevance")
    )
    n = F.coalesce("results", F.lit(0))
    enough = (n >= min_results) & ((n == 0) | (F.col("mean_relevance") >= min_relevance))
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", n.alias("results"), "mean_relevance", F.coalesce(enough, F.lit(False)).alias("sufficient")
    )

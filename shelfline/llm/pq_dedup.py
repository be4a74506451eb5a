"""Near-duplicate embeddings by product quantisation.

Unit vectors are put into the inverted list of their nearest coarse centroid, as codes of their residual in
each subspace.  Every vector asks the lists of its nearest centroids: distances to the codes are summed
from a table made for the uncompressed vector, and those that the coding error cannot rule out are
reranked by the exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from shelfline.llm.common import hash_sample, stored
from shelfline.llm.graph import components, group_starts, sorted_groups
from shelfline.llm.vectors import matrix, packed, prepared, unit, unpacked
from shelfline.operators.scale import salted_join

COSINE = 0.9
#: Lists are probed until so many of the pairs at the least cosine are met, from either side, in a trial on held-out vectors.
FOUND = 0.97
LEAST_PROBES = 6
SUBSPACES = 8
CODES = 64
MOST_LISTS = 4096
#: Vectors per list on which the centroids are fitted, at most ``SAMPLE`` in all; every vector is indexed.
PER_LIST = 32
SAMPLE = 65_536
#: Vectors of the trial, which the centroids have not seen.
TRIAL = 4096
#: Members and queries of a list that one task compares; longer lists are cut into pairs of blocks.
MEMBERS, QUERIES = 2048, 8192
PAIRS = 1 << 21


def kmeans(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = nearest(rows, centres, 1)[:, 0]
        count = np.bincount(near, minlength=len(centres))
        for j in range(rows.shape[1]):
            sums = np.bincount(near, rows[:, j], len(centres))
            centres[count > 0, j] = sums[count > 0] / count[count > 0]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    out = []
    norms = np.einsum("ij,ij->i", centres, centres)
    step = max(1, (1 << 22) // len(centres))
    for at in range(0, len(rows), step):
        d = norms - 2 * rows[at : at + step] @ centres.T
        best = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.argsort(d, axis=1)
        order = np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(best, order, 1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


class Quantiser:
    """Coarse centroids and a codebook for each subspace of the residuals; ``probes`` lists are enough for a question."""

    probes = LEAST_PROBES

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = kmeans(sample, lists)
        residual = sample - self.coarse[nearest(sample, self.coarse, 1)[:, 0]]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.books = [kmeans(residual[:, p], min(CODES, len(sample)), seed=i + 1) for i, p in enumerate(self.parts)]

    def encode(self, rows: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far the coded vector is from the true one."""
        residual = rows - self.coarse[home]
        codes = np.stack([nearest(residual[:, p], b, 1)[:, 0] for p, b in zip(self.parts, self.books)], axis=1)
        coded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((residual - coded) ** 2).sum(1))

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded members of a list, by table look-up."""
        residual = queries - self.coarse[which]
        total = np.zeros((len(queries), len(codes)))
        for i, (p, book) in enumerate(zip(self.parts, self.books)):
            part = residual[:, p]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def list_count(n: int) -> int:
    """About the square root of the vectors, a power of two."""
    return max(1, min(MOST_LISTS, 1 << round(math.log2(max(1.0, math.sqrt(n))))))


def enough_probes(held: np.ndarray, coarse: np.ndarray, cosine: float, found: float = FOUND, seed: int = 3) -> int:
    """How many of the nearest lists a vector has to ask for ``found`` of its pairs at ``cosine``.

    Every held-out vector gets a partner at that cosine in a random direction.  A pair is met if one of
    the two asks the other's list; how near that list is among all decides.
    """
    rng = np.random.default_rng(seed)
    aside = rng.normal(size=held.shape)
    aside -= np.einsum("ij,ij->i", aside, held)[:, None] * held
    partners = cosine * held + math.sqrt(1 - min(1.0, cosine) ** 2) * aside / np.maximum(np.sqrt(np.einsum("ij,ij->i", aside, aside)), 1e-300)[:, None]
    norms = np.einsum("ij,ij->i", coarse, coarse)
    homes = [nearest(side, coarse, 1)[:, 0] for side in (held, partners)]
    places = []
    for side, home in zip((held, partners), reversed(homes)):
        for at in range(0, len(side), 512):
            d = norms - 2 * side[at : at + 512] @ coarse.T
            places.append((d < np.take_along_axis(d, home[at : at + 512, None], 1)).sum(1))
    nearer = np.minimum(*np.split(np.concatenate(places), 2))
    return max(LEAST_PROBES, int(np.quantile(nearer, found, method="higher")) + 1)


def fit(reps: DataFrame, size: int, count: int, cosine: float = COSINE) -> Quantiser:
    """Fitted on a bounded sample, picked by hash; a further part of it tells how many probes are enough."""
    lists = list_count(count)
    rows = min(SAMPLE, max(PER_LIST * lists, CODES * PER_LIST))
    sample = hash_sample(reps, ["h1", "h2"], rows + TRIAL, count).select("vector").toArrow()
    vectors = unit(matrix(sample.column("vector"), size))
    held = min(TRIAL, len(vectors) // 4)
    quantiser = Quantiser(vectors[: len(vectors) - held], min(lists, len(vectors) - held))
    if held:
        quantiser.probes = enough_probes(vectors[-held:], quantiser.coarse, cosine)
    return quantiser


def deal(reps: DataFrame, quantiser: Quantiser, size: int, probes: int, kind: type) -> DataFrame:
    """A member row in the home list and a query row in each probed list of every vector, cut into blocks.

    Vectors travel as they are, in numbers of ``kind``.
    """
    probes = min(probes, len(quantiser.coarse))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                plain = matrix(batch.column("vector"), size)
                rows = unit(plain)
                lists = nearest(rows, quantiser.coarse, probes)
                codes, error = quantiser.encode(rows, lists[:, 0])
                node, times = batch.column("node"), batch.column("times")
                asked = packed(lists.astype(np.int16))
                vector = packed(plain.astype(kind))
                member = [pa.array(lists[:, 0].astype(np.int32)), pa.array(np.zeros(len(rows), np.int32)), node, times, pa.array(error), packed(codes), asked, vector]
                yield pa.RecordBatch.from_arrays(member, NAMES)
                none, zero = pa.array([b""] * len(rows), pa.binary()), pa.array(np.zeros(len(rows)))
                for i in range(probes):
                    query = [pa.array(lists[:, i].astype(np.int32)), pa.array(np.ones(len(rows), np.int32)), node, times, zero, none, asked, vector]
                    yield pa.RecordBatch.from_arrays(query, NAMES)

    rows = reps.select("node", "times", "vector").mapInArrow(work, SCHEMA)
    # a home list holds one row of each member, so its size follows from the members alone; both counts have a row per list
    members, queries = (F.sum((F.col("role") == i).cast("long")) for i in (0, 1))
    rows = stored(rows, "pq-lists")
    sizes = rows.groupBy("list").agg(F.ceil(members / MEMBERS).cast("int").alias("mb"), F.ceil(queries / QUERIES).cast("int").alias("qb"))
    cut = rows.join(F.broadcast(sizes.where("mb > 0")), "list")  # at most MOST_LISTS rows; a list without members answers nobody
    mine = F.when(F.col("role") == 0, F.pmod(F.xxhash64("node"), F.col("mb"))).otherwise(F.pmod(F.xxhash64("node"), F.col("qb")))
    other = F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("qb")).otherwise(F.col("mb")) - 1)
    cut = cut.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(other))
    blocks = F.when(F.col("role") == 0, F.struct(F.col("mine").alias("m"), F.col("other").alias("q"))).otherwise(F.struct(F.col("other").alias("m"), F.col("mine").alias("q")))
    cut = cut.withColumn("b", blocks).select("list", F.col("b.m").alias("mblock"), F.col("b.q").alias("qblock"), *NAMES[1:])
    return cut.repartition("list", "mblock", "qblock").sortWithinPartitions("list", "mblock", "qblock", "role")


NAMES = ["list", "role", "node", "times", "error", "codes", "asked", "vector"]
SCHEMA = "list int, role int, node long, times long, error double, codes binary, asked binary, vector binary"


def links(dealt: DataFrame, quantiser: Quantiser, size: int, cosine: float, kind: type) -> DataFrame:
    """``node, links, other`` rows: links of a node by multiplicity, and an edge to a node it is connected with.

    Every pair is counted once, in one of the lists where it can be found; pairs are never listed.  A group
    gives at most one row for each of its vectors.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in sorted_groups(batches, 3):
            starts = np.append(group_starts(columns[:3]), len(columns[0]))
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                node, found, other = _group([c[s:e] for c in columns], quantiser, size, cosine, kind)
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(found), pa.array(other)], ["node", "links", "other"])

    return dealt.mapInArrow(work, "node long, links long, other long")


def _group(columns: list[np.ndarray], quantiser: Quantiser, size: int, cosine: float, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    which, _, _, role, node, times, error, codes, asked, vector = columns
    n = int((role == 0).sum())  # members stand first
    if not n or n == len(role):
        return node[:0], node[:0], node[:0]
    lists = unpacked(asked, np.int16, len(asked[0]) // 2)
    rows = unit(unpacked(vector, kind, size).astype(np.float64))
    codes = unpacked(codes[:n], np.uint8, len(quantiser.parts))
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    count = np.zeros(len(node), np.int64)
    names, index = np.unique(node, return_inverse=True)  # a vector may be member and query
    label = np.arange(len(names))
    step = max(1, PAIRS // n)
    for at in range(n, len(node), step):
        to = min(at + step, len(node))
        q, m = np.nonzero(quantiser.distances(rows[at:to], int(which[0]), codes) - error[:n] <= reach)
        q += at
        # of the two directions in which a pair may be met, the smaller node's question counts
        twice = (lists[m] == lists[q, :1]).any(1)
        keep = (node[q] < node[m]) | (node[q] > node[m]) & ~twice
        q, m = q[keep], m[keep]
        for part in range(0, len(q), 1 << 17):
            i, j = q[part : part + (1 << 17)], m[part : part + (1 << 17)]
            near = np.einsum("ij,ij->i", rows[i], rows[j]) >= cosine
            i, j = i[near], j[near]
            np.add.at(count, i, times[j])
            np.add.at(count, j, times[i])
            _connect(label, index[i], index[j])
    total = np.zeros(len(names), np.int64)
    np.add.at(total, index, count)
    hit = np.flatnonzero(total)
    return names[hit], total[hit], names[label[hit]]


def _connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of every pair the smallest label that they reach."""
    while True:
        low = np.minimum(label[a], label[b])
        far = (label[a] != low) | (label[b] != low)
        if not far.any():
            break
        for side in (a[far], b[far]):
            np.minimum.at(label, label[side], low[far])
            np.minimum.at(label, side, low[far])
        label[:] = label[label]
    while True:  # down to the roots
        root = label[label]
        if (root == label).all():
            return
        label[:] = root


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, probes: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``embeddings``, whatever its other columns.

    ``probes`` is how many lists a vector asks; without it, as many as a trial on held-out vectors needs.

    Vectors are linked from ``cosine`` on, in double precision.  Equal vectors are one entry of the index
    with its multiplicity.  Vectors that are null, empty or zero, hold null or non-finite components or have
    another size than most, link with nothing and are their own component.  Null ids keep their row, never
    name a component and are never kept.  Repeated rows are vectors of their own that link with each other.
    An empty table gives no rows.
    """
    rows, size = prepared(embeddings)
    spark = embeddings.sparkSession
    valid = rows.where("ok")
    first = valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"), F.first("vector").alias("vector"))
    # numbered once, when written
    reps = stored(first.withColumn("node", F.monotonically_increasing_id()), "pq-vectors")
    count = reps.count()
    if count:
        quantiser = fit(reps, size, count, cosine)
        kind = np.float32 if embeddings.schema["embedding"].dataType.elementType == FloatType() else np.float64
        dealt = deal(reps, quantiser, size, probes or quantiser.probes, kind)
        found = stored(links(dealt, quantiser, size, cosine, kind), "pq-links")
    else:
        found = spark.createDataFrame([], "node long, links long, other long")
    per = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = reps.select("h1", "h2", "node", "least", "times").join(per, "node", "left").join(roots, "node", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "node")), "pq-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    total = F.col("times") - 1 + F.coalesce("links", F.lit(0))
    classes = named.join(ids, "root").select("h1", "h2", total.alias("n_links"), "component_id")
    out = salted_join(rows.where("ok").select("vec_id", "h1", "h2"), stored(classes, "pq-classes"), ["h1", "h2"], spread=["vec_id"])
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

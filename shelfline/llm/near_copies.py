"""Near copies by the exact Jaccard similarity of word shingles.

Two texts are linked if the sets of their shingles of five words are at least 0.8 alike.  Candidates are what
``simhash`` links, fingerprints of three-word shingles within three bits, and sets that share
one of 48 keys, each made of the least values of six hash functions over the shingles: a pair at 0.8 has
none in common once in two million, a more similar one far less often.  Every candidate is counted exactly
before it is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import cut, free_names, stored, text_key, text_of
from shelfline.llm.graph import components, forest, group_starts, sorted_groups
from shelfline.llm.simhash import BATCH, fingerprint, linked, shingles
from shelfline.operators.scale import salted_join

SHINGLE = 5
SIMILARITY = 0.8
KEYS = 48
HASHES = 6
#: Groups of one key up to this size list their pairs; in larger ones the sets themselves are compared.
SMALL = 8
#: Sets of one key that are compared in one task, and their shingles; larger groups are cut into pairs of such blocks.
BLOCK = 512
SHINGLES = 4 << 20

_RANDOM = np.random.default_rng(42)
_FACTOR = _RANDOM.integers(0, 1 << 63, KEYS * HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RANDOM.integers(0, 1 << 63, KEYS * HASHES, np.uint64)


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles; none for a text without words."""
    return np.unique(shingles(text, size))


def keys_of(tokens: np.ndarray) -> np.ndarray:
    """The keys of a set; sets of equal keys are candidates.  Texts without words have none."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    least = np.full(KEYS * HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 1 << 10):  # small enough for the processor's cache
        part = tokens[at : at + (1 << 10)]
        for i in range(0, KEYS * HASHES, 16):
            mixed = (part ^ _TURN[i : i + 16, None]) * _FACTOR[i : i + 16, None]
            # the high bits of a product are the well mixed ones; its order is theirs
            least[i : i + 16] = np.minimum(least[i : i + 16], mixed.min(1))
    rows = least.reshape(KEYS, HASHES)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64)


def prints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, text_key, fp, n, sim, keys``: ``fp`` is a hash of the set of ``n`` shingles, 0 for no words, ``sim`` the SimHash."""
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text_key(documents, "doc_id").alias("text_key"), text_of(documents).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, BATCH):
                texts = batch.column("text").to_pylist()
                sets = [shingle_set(t, size) for t in texts]
                sim = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                fp = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                keys = pa.array([keys_of(s) for s in sets], pa.list_(pa.int64()))
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp), n, pa.array(sim), keys], ["doc_id", "text_key", "fp", "n", "sim", "keys"])

    return rows.mapInArrow(work, "doc_id long, text_key long, fp long, n long, sim long, keys array<long>")


def alike(a: int, b: int, common: np.ndarray | int, similarity: float = SIMILARITY) -> np.ndarray | bool:
    """Whether sets of ``a`` and ``b`` tokens with ``common`` ones are similar enough."""
    return common >= similarity * (a + b - common) - 1e-9


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_key").alias("t"))


def _named(documents: DataFrame, ident: str, key: str) -> DataFrame:
    return documents.withColumn(ident, F.coalesce(documents["doc_id"].cast("long"), F.lit(-1))).withColumn(key, text_key(documents, "doc_id"))


def _sets(documents: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """``fp, tokens`` (bytes) of the documents that ``first`` (``fp, o``) names."""
    plain = documents.select(documents["doc_id"], documents["text"])
    ident, key = free_names(plain, "near_id", "near_key")
    chosen = first.select(F.coalesce("o.d", F.lit(-1)).alias(ident), F.col("o.t").alias(key), "fp")
    met = _named(plain, ident, key).join(chosen, [ident, key]).select("fp", text_of(plain).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, BATCH):
                sets = [shingle_set(t, size).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.binary())], ["fp", "tokens"])

    return met.mapInArrow(work, "fp long, tokens binary").dropDuplicates(["fp"])


def _small_pairs(met: DataFrame) -> DataFrame:
    """``a, b``: the pairs of the groups, a < b."""
    dealt = met.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in sorted_groups(batches, 1):
            starts = group_starts([key])
            end = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
            sides = []
            for step in range(1, SMALL):
                at = np.flatnonzero(np.arange(len(key)) + step < end)
                sides.append((fp[at], fp[at + step]))
            a, b = (np.concatenate(side) for side in zip(*sides))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(work, "a long, b long").distinct()


def _simhash_pairs(found: DataFrame) -> DataFrame:
    """``a, b``: the first set of each SimHash with all others of it, and with the first sets of those that ``linked`` finds."""
    met = found.where("n > 0").select("fp", "sim").distinct()
    first = stored(met.groupBy("sim").agg(F.min("fp").alias("first")), "near-simhash")
    same = salted_join(met, first, ["sim"], spread=["fp"]).select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = linked(first.select(F.col("sim").alias("fp")))
    for side in ("a", "b"):
        near = salted_join(near, first.select(F.col("sim").alias(side), F.col("first").alias(f"first_{side}")), [side], spread=["a", "b"])
    near = near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return same.unionByName(near).where("a < b").distinct()


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets are similar enough."""
    left = salted_join(pairs, sets.select(F.col("fp").alias("a"), F.col("tokens").alias("x")), ["a"], spread=["a", "b"])
    both = salted_join(left, sets.select(F.col("fp").alias("b"), F.col("tokens").alias("y")), ["b"], spread=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(side.as_buffer(), np.uint64) for side in (x, y))
                few, many = sorted((len(x), len(y)))
                # a length that rules the pair out needs no count
                good.append(bool(alike(few, many, few, similarity) and alike(few, many, len(np.intersect1d(x, y, assume_unique=True)), similarity)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _compared(met: DataFrame, sets: DataFrame, block: int, similarity: float) -> DataFrame:
    """Edges that connect the similar sets of each large group, at most one less than sets for a pair of blocks.

    A block holds about ``block`` sets, and ``SHINGLES`` shingles, of a group.
    """
    cutting = met.withColumn("blocks", F.ceil(F.greatest(F.col("n") / block, F.col("total") / SHINGLES)).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = cutting.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "fp")
    full = salted_join(dealt, sets, ["fp"], spread=["key", "lo", "hi"]).select("key", "lo", "hi", "mine", "fp", "tokens")
    full = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, lo, hi, mine, fp, tokens in sorted_groups((p for b in batches for p in cut(b, BATCH)), 3):
            starts = group_starts([key, lo, hi])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                at = np.arange(e - s)
                first, second = (at, at) if lo[s] == hi[s] else (at[mine[s:e] == lo[s]], at[mine[s:e] == hi[s]])
                found = _links([np.frombuffer(t, np.uint64) for t in tokens[s:e]], first, second, similarity)
                if found:
                    i, j = fp[s:e][np.array(found).T]
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], ["a", "b"])

    return full.mapInArrow(work, "a long, b long")


def _links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links within a group, by a list of the sets that hold each token."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders, start = owner[order], np.append(0, np.cumsum(np.bincount(token)))
    at = np.append(0, np.cumsum(size))

    def near(i: int, js: np.ndarray) -> np.ndarray:
        mine = token[at[i] : at[i + 1]]
        common = np.bincount(np.concatenate([holders[start[t] : start[t + 1]] for t in mine.tolist()]), minlength=len(sets))
        return alike(size[i], size[js], common[js], similarity)

    return forest(near, second, first)


def _member_marks() -> list[Column]:
    """Equal for groups of equal members: two sums of hashes of 64 bits, so unequal groups agree by chance once in 2^128."""
    return [F.sum(F.xxhash64(F.lit(i), "fp").cast("decimal(20,0)")).alias(name) for i, name in enumerate(("mark", "mark2"))]


def classes(documents: DataFrame, found: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``fp, root`` for each distinct set of the stored ``prints`` of the documents."""
    uniq = stored(found.groupBy("fp").agg(F.min(_order()).alias("o"), F.first("n").alias("size"), F.first("keys").alias("keys")), "near-sets")
    keyed = uniq.select("fp", "size", F.explode("keys").alias("key"))
    # groups with the same members count once: near copies share most of their keys
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), *_member_marks()).where("n > 1")
    groups = groups.groupBy("n", "total", "mark", "mark2").agg(F.min("key").alias("key"))
    met = stored(keyed.drop("size").join(groups.select("key", "n", "total"), "key"), "near-groups")
    small, large = met.where(F.col("n") <= SMALL), met.where(F.col("n") > SMALL)
    pairs = stored(_small_pairs(small).unionByName(_simhash_pairs(found)).distinct(), "near-pairs")
    wanted = met.select("fp").unionByName(pairs.select(F.col("a").alias("fp"))).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = stored(_sets(documents, uniq.join(wanted, "fp", "left_semi").select("fp", "o"), size), "near-tokens")
    edges = _checked(pairs, sets, similarity).unionByName(_compared(large, sets, block, similarity))
    roots = components(edges)
    return uniq.select("fp").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def keep_one(documents: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, with all columns: the smallest ``doc_id`` (nulls last), then text key.

    Repeated rows are one document, an empty table gives no rows, and very long texts are read whole.  Texts of equal shingles are one set and never paired; all texts without words are one group, null as
    empty.  Words are cut as in ``simhash``: at ASCII white space, in ASCII lower case.
    """
    found = stored(prints(documents, size), "near-prints")
    rooted = stored(classes(documents, found, size, similarity), "near-classes")
    ident, key = free_names(documents, "near_id", "text_key")
    best = salted_join(found.select("doc_id", "text_key", "fp"), rooted, ["fp"], spread=["doc_id", "text_key"]).groupBy("root").agg(F.min(_order()).alias("o"))
    best = best.select(F.coalesce("o.d", F.lit(-1)).alias(ident), F.col("o.t").alias(key))
    return _named(documents, ident, key).join(best, [ident, key], "left_semi").dropDuplicates([ident, key]).select(*documents.columns)

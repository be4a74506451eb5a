"""SimHash near-duplicates with pigeonring filtering.

The 64 bits stand on a ring of eight segments.  If two fingerprints differ in at most three bits, some
segment starts a chain of which every first l segments differ in at most 3 * l / 8 bits: none in the first
two, one in the first five, two in the first seven.  The first two segments and one half of the next three
are thus equal, which makes the 28-bit keys of 16 tables; the rest of the chain and the full Hamming
distance are checked within equal keys.
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
from shelfline.operators.scale import salted_join

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 8
#: Fingerprints of one key that are compared in one task; larger groups are cut into pairs of such blocks.
BLOCK = 4096
BATCH = 4 << 20


def shingles(text: str, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words, in order; a shorter text is one run, a text without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    end = (start + length)[min(size, len(words)) - 1 :]
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), end.tolist())), np.uint64, n)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text."""
    hashes = shingles(text, size)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text needs no large matrix
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, text_key, fp``: the SimHash as a signed long; whole texts, null as empty."""
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text_key(documents, "doc_id").alias("text_key"), text_of(documents).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, BATCH):
                fp = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp)], ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(work, "doc_id long, text_key long, fp long")


def table_keys(fp: Column) -> Column:
    """The 16 keys of a fingerprint: table, two whole segments, half of the next three."""
    keys = []
    for i in range(SEGMENTS):
        turned = fp if i == 0 else F.shiftrightunsigned(fp, 8 * i).bitwiseOR(F.shiftleft(fp, 64 - 8 * i))
        first = F.shiftleft(turned.bitwiseAND(F.lit(0xFFFF)), 12)
        for half in (0, 1):
            part = F.shiftrightunsigned(turned, 16 + 12 * half).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((2 * i + half) << 28).cast("long").bitwiseOR(first).bitwiseOR(part))
    return F.array(*keys)


def chain_holds(x: np.ndarray, rotation: np.ndarray | int) -> np.ndarray:
    """The rest of the chain for differences ``x`` of pairs whose key is equal, then the full distance."""
    r = np.uint64(8) * np.asarray(rotation, np.uint64)
    turned = (x >> r) | (x << ((np.uint64(64) - r) & np.uint64(63)))
    out = np.ones(x.shape, bool)
    for segments, most in ((5, DISTANCE * 5 // 8), (7, DISTANCE * 7 // 8), (8, DISTANCE)):
        mask = np.uint64((1 << (8 * segments)) - 1)
        out &= np.bitwise_count(turned & mask) <= most
    return out


def linked(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` that connect the distinct fingerprints ``fp`` within ``DISTANCE`` bits.

    Not all pairs are listed: a group of n fingerprints gives at most n - 1 edges for each pair of blocks.
    A key that holds very many is cut into blocks, and every pair of blocks is a task's work of its own.
    """
    keyed = fps.select("fp", F.explode(table_keys(F.col("fp"))).alias("key"))
    count = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(count, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "fp")
    dealt = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, lo, hi, mine, fp in sorted_groups(batches, 3):
            a, b = _edges(key, lo, hi, mine, fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(work, "a long, b long")


def _edges(key, lo, hi, mine, fp) -> tuple[np.ndarray, np.ndarray]:
    starts = group_starts([key, lo, hi])
    size = np.diff(np.append(starts, len(key)))
    rotation = (key >> 29).astype(np.uint64)
    # most groups are two fingerprints: all of them at once
    two = starts[size == 2]
    two = two[chain_holds(fp[two] ^ fp[two + 1], rotation[two])] if len(two) else two
    pairs = [(fp[two], fp[two + 1])]
    for s, n in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
        group, turn, at = fp[s : s + n], rotation[s], np.arange(n)
        first, second = (at, at) if lo[s] == hi[s] else (at[mine[s : s + n] == lo[s]], at[mine[s : s + n] == hi[s]])
        found = forest(lambda i, js: chain_holds(group[js] ^ group[i], turn), second, first)
        if found:
            i, j = np.array(found).T
            pairs.append((group[i], group[j]))
    return tuple(np.concatenate(side) for side in zip(*pairs))


def classes(prints: DataFrame) -> DataFrame:
    """``fp, root, component_id`` for each distinct fingerprint of stored ``doc_id, fp`` rows."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(linked(least.select("fp")))
    rooted = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = stored(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document.

    Fingerprints within 3 bits are linked; ``component_id`` is the smallest ``doc_id`` that links reach.
    Copies share one fingerprint, so they are never paired.  Null texts are empty and have fingerprint
    zero, which is linked like any other.  Null ids keep their row and never name a component (null if it
    has no other id).  Repeated rows are documents of their own; an empty table gives no rows; other
    columns are ignored.
    """
    prints = stored(fingerprints(documents, size), "simhash")
    found = stored(classes(prints).select("fp", "component_id"), "simhash-classes")
    out = salted_join(prints, found, ["fp"], spread=["doc_id", "text_key"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each component, with all columns: the smallest ``doc_id`` (nulls last), then text key."""
    prints = stored(fingerprints(documents, size), "simhash")
    found = stored(classes(prints).select("fp", "root"), "simhash-classes")
    ident, key = free_names(documents, "simhash_id", "text_key")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
    best = salted_join(prints, found, ["fp"], spread=["doc_id", "text_key"]).groupBy("root").agg(F.min(order).alias("o"))
    best = best.select(F.coalesce("o.d", F.lit(-1)).alias(ident), F.col("o.t").alias(key))
    named = documents.withColumn(ident, F.coalesce(documents["doc_id"].cast("long"), F.lit(-1))).withColumn(key, text_key(documents, "doc_id"))
    return named.join(best, [ident, key], "left_semi").dropDuplicates([ident, key]).select(*documents.columns)

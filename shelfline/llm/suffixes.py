"""Removal of repeated passages with a logarithmic family of suffix arrays.

A suffix array of every byte would be many times the text.  Here it is sparse: of each string of ``LENGTH``
bytes, the suffix that starts at its smallest hashed ``GRAM``-byte gram is indexed.  That place depends on
nothing but the string, so wherever the string occurs, the same suffix of it is indexed, and one entry
stands for all strings in a row that share it.  Entries are sorted by the fingerprint of the suffix's first
bytes: the merge scan needs equal prefixes to meet, and this order spreads evenly.

Documents come in batches.  The suffix array of a batch is a bucketed, sorted table; it is merge-scanned
against the table of each level, bucket by bucket without a shuffle, and levels of equal size are merged
before the next batch.  A scan finds entries with the same strings (all of them are repeated) and prefixes
that go on in different ways; of the latter the exact strings are compared afterwards.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import bytes_of, cut, partitions, stored, text_key, text_of
from shelfline.llm.graph import sorted_groups
from shelfline.operators.scale import new_path

LENGTH = 200
GRAM = 32  # a power of two
BATCHES = 4
#: Contexts of one prefix that are compared in one task; beyond, their strings are dealt out by hash.
TOGETHER = 4096
BATCH = 2 << 20
#: Strings that are hashed at once start in so many bytes; places within have that many bits.
SLICE, PLACE_BITS = 1 << 23, 24

_RANDOM = np.random.default_rng(20240602)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)
_LEVEL = [np.uint64(x | 1) for x in _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64).tolist()]
_SHIFT = np.uint64(31)


# -- sparse suffixes of a text ------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all grams, by doubling: of 2, 4, 8 ... bytes."""
    h, size, level = _BYTE[data], 1, 0
    while size < gram:
        h = h[:-size] * _LEVEL[level] + h[size:]
        size, level = 2 * size, level + 1
    h ^= h >> _SHIFT
    h *= _LEVEL[level]
    h ^= h >> _SHIFT
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def entries(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``row, place, left, right, key`` of the indexed suffixes of the rows of ``data``.

    The strings that start in ``[place - left, place + right - length]`` are those the entry stands for.
    A very long text is taken in slices by where the strings start.
    """
    parts = []
    for begin in range(0, max(1, len(data)), SLICE):
        end = min(len(data), begin + SLICE + length - 1)
        edges = np.clip(at, begin, end)
        row, place, left, right, key = _slice_entries(data[begin:end], edges - begin, length, gram)
        parts.append((row, place + begin - at[row], left, right, key))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _slice_entries(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The same for at most ``SLICE`` starts; ``place`` counts from the start of ``data``."""
    none = np.zeros(0, np.int64)
    size = np.diff(at)
    if not len(size) or size.max() < length:
        return none, none, none, none, none.view(np.uint64)
    hashes = gram_hashes(data, gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    # smallest 40 bits of the hash, then leftmost: both depend on the string alone
    least = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    count = np.maximum(size - length + 1, 0)  # strings by row
    row = np.repeat(np.arange(len(size)), count)
    start = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = (least[start] & low).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    p = place[first]
    return row[first], p, p - start[first], start[last] + length - p, hashes[p]


# -- levels of sorted tables ---------------------------------------------------------------

ENTRY = "deal long, key long, ctx long, id long, chk long, place int, l short, r short, kind short, heavy boolean"
NAMES = [f.split()[0] for f in ENTRY.split(", ")]
#: Kinds of entries: nothing known, known to be repeated, and (not indexed) another place of such a one.
OPEN, KNOWN, MORE = 0, 1, 2
#: One document in so many is looked at to find prefixes that many entries share.
HEAVY_SAMPLE = 16
#: A batch is dealt to as many buckets as there are shuffle partitions, or fewer of at least so many entries.
PER_BUCKET = 5000


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings that hold for the jobs inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def suffix_array(texts: DataFrame, length: int = LENGTH, heavy: np.ndarray | None = None) -> DataFrame:
    """The entries of ``id, chk, text`` rows; ``deal`` is the value by which they are dealt to buckets.

    Equal entries of one Arrow batch are combined before the shuffle: the first stays in the index as
    ``KNOWN``, the others only carry their place (``MORE``) and are dealt by it, so a passage that a third of
    all documents share puts one entry for each batch into its bucket.  Entries of ``heavy`` prefixes are
    dealt by their whole string.  All others are dealt by their prefix.
    """
    heavy = np.zeros(0, np.int64) if heavy is None else heavy

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, BATCH):
                data, at = bytes_of(batch.column("text"))
                row, place, left, right, key = entries(data, at, length)
                if not len(row):
                    continue
                text, begin = data.tobytes(), at[row] + place
                spans = zip((begin - left).tolist(), (begin + right).tolist())
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in spans), np.uint64, len(row))
                order = np.lexsort((ctx, key))
                again = np.zeros(len(row) + 1, bool)
                again[1:-1] = (key[order][1:] == key[order][:-1]) & (ctx[order][1:] == ctx[order][:-1])
                kind = np.empty(len(row), np.int16)
                kind[order] = np.where(again[:-1], MORE, np.where(again[1:], KNOWN, OPEN))
                ids, chk = batch.column("id").to_numpy()[row], batch.column("chk").to_numpy()[row]
                many = np.isin(key.view(np.int64), heavy)
                deal = np.where(many, key * _LEVEL[-1] + ctx, key)
                more = kind == MORE
                deal[more] = (ids[more].view(np.uint64) * _LEVEL[-2] + place[more].astype(np.uint64)) * _LEVEL[-3]
                key[more], ctx[more] = 0, 0
                columns = [deal.view(np.int64), key.view(np.int64), ctx.view(np.int64), ids, chk, place.astype(np.int32), left.astype(np.int16), right.astype(np.int16), kind, many]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES)

    return texts.select("id", "chk", "text").mapInArrow(work, ENTRY)


def sampled(texts: DataFrame, length: int) -> tuple[int, DataFrame]:
    """About how many entries the texts have, and the sampled entries by prefix."""
    some = suffix_array(texts.where(F.pmod(F.xxhash64("chk"), F.lit(HEAVY_SAMPLE)) == 0), length).where(F.col("kind") < MORE)
    counts = stored(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "suffix-sample")
    return counts.agg(F.sum("n")).first()[0] or 0, counts


def heavy_prefixes(total: int, counts: DataFrame, buckets: int) -> np.ndarray:
    """Prefixes with more than a quarter of an average bucket's entries in the sample.

    At most four times as many as buckets.  It only decides how entries are dealt, not what is found.
    """
    found = counts.where((F.col("n") > 2) & (F.col("n") > total / (4.0 * buckets))).select("key").collect()
    return np.array(sorted(r["key"] for r in found), np.int64)


@dataclass
class SuffixIndex:
    """The family: at most one table for each power of two of batches, but for the last one added.

    ``repeated`` and ``mixed`` collect what the scans find: entries whose strings occur again, and prefixes
    that go on in different ways.
    """

    spark: SparkSession
    length: int = LENGTH
    levels: list[tuple[int, str]] = field(default_factory=list)
    repeated: list[DataFrame] = field(default_factory=list)
    mixed: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = 0  # set by the first batch, as are the heavy prefixes
        self.heavy: np.ndarray | None = None

    def _write(self, rows: DataFrame) -> str:
        """A sorted table below the shared folder, as many buckets as the first batch asked for."""
        name = f"suffixes_{uuid.uuid4().hex}"
        path = new_path(self.spark, "suffixes")
        order = ("deal", "key", "ctx")
        sorted_rows = rows.sortWithinPartitions(*order)
        sorted_rows.write.bucketBy(self.buckets, "deal").sortBy(*order).option("path", path).option("compression", "zstd").saveAsTable(name)
        return name

    def _merge(self) -> None:
        """Levels of equal size become one, until all sizes differ."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._write(self.spark.table(a).unionByName(self.spark.table(b)))))
            for name in (a, b):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Forget the tables of the levels; their files stay in the shared folder."""
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _local(self):
        """Buckets dealt by ``deal`` serve for ``deal, key, ctx`` as well: joins need no shuffle."""
        return settings(self.spark, spark__sql__requireAllClusterKeysForCoPartition="false")

    def add(self, texts: DataFrame) -> None:
        """Index a batch of ``id, chk, text`` and scan it against itself and every level."""
        self._merge()
        if self.heavy is None:
            total, counts = sampled(texts, self.length)
            wanted = max(1, min(partitions(self.spark), total * HEAVY_SAMPLE // PER_BUCKET))
            # asked for through the session, as one that pins its partitions would deal rows to more tasks than buckets
            with settings(self.spark, spark__sql__shuffle__partitions=str(wanted)):
                self.buckets = partitions(self.spark)
            self.heavy = heavy_prefixes(total, counts, self.buckets)
        rows = suffix_array(texts, self.length, self.heavy).repartition(self.buckets, "deal")
        name = self._write(rows)
        with self._local():
            mine = self.spark.table(name).where(F.col("kind") < MORE)
            own = mine.groupBy("deal", "key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"))
            ends = mine.groupBy("deal").agg(F.min("ctx").alias("lo"), F.max("ctx").alias("hi"))
            again = own.where((F.col("n") > 1) | (F.col("kind") == KNOWN)).select("deal", "key", "ctx")
            other = ends.where("lo < hi").select("deal")
            for _, level in self.levels:
                old = self.spark.table(level).where(F.col("kind") < MORE)
                seen = old.groupBy("deal", "key", "ctx").agg(F.count(F.lit(1)).alias("m"))
                borders = old.groupBy("deal").agg(F.min("ctx").alias("lo2"), F.max("ctx").alias("hi2"))
                again = again.unionByName(own.join(seen, ["deal", "key", "ctx"]).select("deal", "key", "ctx"))
                other = other.unionByName(ends.join(borders, "deal").where("least(lo, lo2) < greatest(hi, hi2)").select("deal"))
            self.repeated.append(stored(again, "suffix-repeated"))
            self.mixed.append(stored(other, "suffix-mixed"))
        self.levels.append((1, name))

    def found(self) -> tuple[DataFrame, DataFrame]:
        """Spans ``id, chk, a, b`` of entries whose strings are all repeated, and what is still to compare.

        The latter has one row for each kind of string of a mixed prefix, with ``many``: whether it is
        known to be repeated and only stands there as a partner.
        """
        spans, open_ = [], []
        place = ("id", "chk", "place - l as a", "place + r as b")
        with self._local():
            again = _union(self.repeated).distinct().withColumn("many", F.lit(True))
            mixed = _union(self.mixed).distinct().withColumn("mix", F.lit(True))
            for _, level in self.levels:
                table = self.spark.table(level)
                spans.append(table.where(F.col("kind") == MORE).selectExpr(*place))
                rows = table.where(F.col("kind") < MORE).join(again, ["deal", "key", "ctx"], "left")
                spans.append(rows.where("many").selectExpr(*place))
                partner = rows.join(mixed, "deal", "left").where("mix or heavy").groupBy("deal", "key", "ctx")
                one = F.min(F.struct("id", "chk", "place", "l", "r")).alias("e")
                open_.append(partner.agg(F.max(F.coalesce("many", F.lit(False))).alias("many"), F.max("heavy").alias("heavy"), one))
            full = stored(_union(spans), "suffix-spans")
            rest = _union(open_).groupBy("deal", "key", "ctx").agg(F.max("many").alias("many"), F.max("heavy").alias("heavy"), F.min("e").alias("e"))
            rest = stored(rest.select("key", "many", "heavy", "e.*"), "suffix-open")
        return full, rest


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# -- strings of prefixes that go on in different ways -----------------------------------------


def _tables(length: int) -> tuple[int, np.ndarray]:
    """Columns left of the prefix, and a random number for each column and byte."""
    left = length - GRAM
    return left, np.random.default_rng(20240603).integers(0, 1 << 63, (left + length, 256), dtype=np.uint64)


def string_hashes(contexts: list[bytes], left: np.ndarray, right: np.ndarray, length: int, tables) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings that start ``x`` bytes left of the prefix, by row and ``x``, and which there are.

    Rows stand with their prefixes in one column, so equal strings of equal ``x`` have equal sums.
    """
    most, table = tables
    sums = np.zeros((len(contexts), most + length + 1), np.uint64)
    size = left + right
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    row = np.repeat(np.arange(len(contexts)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(most - left, size)
    sums[row, column + 1] = table[column, flat]
    np.cumsum(sums, axis=1, out=sums)
    x = np.arange(most + 1)
    there = (x <= left[:, None]) & (length - x <= right[:, None])
    begin = most - x
    return sums[:, begin + length] - sums[:, begin], there


def compare(rows: DataFrame, length: int) -> DataFrame:
    """Spans of repeated strings among rows ``key, id, chk, place, l, r, many, text`` of the same prefix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(length)
        for columns in sorted_groups(batches, 1):
            key = columns[0]
            starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            at = 0
            while at < len(starts) - 1:  # whole groups, some thousand rows at a time
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + TOGETHER, "right")) - 1)
                part = slice(starts[at], starts[to])
                at = to
                yield _compared([c[part] for c in columns], length, tables)

    dealt = rows.select("key", "id", "chk", "place", "l", "r", "many", "text").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(work, "id long, chk long, a int, b int")


def _compared(columns: list[np.ndarray], length: int, tables) -> pa.RecordBatch:
    _, ids, chk, place, left, right, many, text = columns
    place, left, right = place.astype(np.int64), left.astype(np.int64), right.astype(np.int64)
    hashes, there = string_hashes(list(text), left, right, length, tables)
    twice = np.zeros(there.shape, bool)
    for x in range(there.shape[1]):
        rows = np.flatnonzero(there[:, x])
        if len(rows) < 2:
            continue
        h = hashes[rows, x]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice[rows[order[1:][same]], x] = True
        twice[rows[order[:-1][same]], x] = True
    twice[many.astype(bool)] = False  # removed already
    # runs of neighbouring strings are one span
    edge = np.diff(np.pad(twice.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    a, b = place[row] - last, place[row] - first + length
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(chk[row]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["id", "chk", "a", "b"])


def compare_apart(rows: DataFrame, length: int) -> DataFrame:
    """The same for prefixes with very many contexts: the strings themselves are dealt out and counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(length)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                key, ids, chk, place, left, right, text = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "chk", "place", "l", "r", "text"))
                hashes, there = string_hashes(list(text), left.astype(np.int64), right.astype(np.int64), length, tables)
                row, x = np.nonzero(there)
                columns = [key[row], x.astype(np.int32), hashes[row, x].view(np.int64), ids[row], chk[row], (place[row] - x).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "x", "h", "id", "chk", "a"])

    strings = rows.mapInArrow(work, "key long, x int, h long, id long, chk long, a int")
    twice = strings.groupBy("key", "x", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return strings.join(twice, ["key", "x", "h"], "left_semi").select("id", "chk", "a", (F.col("a") + length).alias("b"))


def contexts(texts: DataFrame, rest: DataFrame) -> DataFrame:
    """The bytes around each open entry, cut out where the text is."""
    wanted = rest.groupBy("id", "chk").agg(F.collect_list(F.struct("key", "many", "place", "l", "r")).alias("e"))
    names = ["key", "many", "place", "l", "r"]
    # all columns of the text go on, so that its shuffle is the one that the operator ends with
    rows = texts.join(wanted, ["id", "chk"]).select(*texts.columns, *[F.col(f"e.{n}").alias(n) for n in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, BATCH):
                lists = [batch.column(n) for n in names]
                count = np.diff(np.asarray(lists[0].offsets))
                row = np.repeat(np.arange(batch.num_rows), count)
                values = [c.flatten() for c in lists]
                place, left, right = (v.to_numpy().astype(np.int64) for v in values[2:])
                data, at = bytes_of(batch.column("text"))
                text, begin = data.tobytes(), at[row] + place
                parts = pa.array([text[a:b] for a, b in zip((begin - left).tolist(), (begin + right).tolist())], pa.binary())
                ids = [pa.array(batch.column(n).to_numpy()[row]) for n in ("id", "chk")]
                yield pa.RecordBatch.from_arrays([values[0], *ids, *values[2:], values[1], parts], ["key", "id", "chk", "place", "l", "r", "many", "text"])

    return rows.mapInArrow(work, "key long, id long, chk long, place int, l short, r short, many boolean, text binary")


# -- the operator -----------------------------------------------------------------------------


def repeated_spans(texts: DataFrame, dealt: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """Spans ``id, chk, a, b`` that cover every string of ``length`` bytes that also starts elsewhere.

    ``dealt`` are the same rows dealt by ``id, chk``; a plan that uses them again shares that shuffle.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings have {2 * GRAM} bytes at least")
    spark = texts.sparkSession
    index = SuffixIndex(spark, length)
    for i in range(batches):
        index.add(texts.where(F.pmod(F.col("chk"), F.lit(batches)) == i))
    full, rest = index.found()
    index.close()
    count = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("heavy").alias("heavy"))
    hot = stored(count.where((F.col("n") > TOGETHER) | F.col("heavy")).select("key"), "suffix-hot")
    out = full.unionByName(compare(contexts(dealt, rest.join(hot, "key", "left_anti")), length))
    if not hot.isEmpty():
        out = out.unionByName(compare_apart(contexts(dealt, rest.join(hot, "key", "left_semi")), length))
    return out


def keyed_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, id, chk, text``: ``id`` without nulls, and 64 bits that tell apart rows of one id."""
    return documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(documents["doc_id"].cast("long"), F.lit(-1).cast("long")).alias("id"),
        text_key(documents, "doc_id").alias("chk"),
        text_of(documents).alias("text"),
    )


def remove_repeats(documents: DataFrame, length: int = LENGTH, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left) per document.

    A byte goes if a string of ``length`` bytes that covers it also starts at another place, in any
    document or its own; strings are judged on the input, and a string within two documents is none.
    Null texts are empty; shorter texts are kept whole; null ids and repeated rows are documents of their
    own (so repeated rows of ``length`` bytes or more go entirely); an empty table gives no rows; other
    columns are ignored.
    """
    texts = keyed_texts(documents)
    dealt = texts.repartition("id", "chk")
    spans = repeated_spans(texts, dealt, length, batches)
    per = spans.groupBy("id", "chk").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    rows = dealt.join(per, ["id", "chk"], "left").select("doc_id", "text", "a", "b")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, BATCH):
                out = [_kept(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("text", "a", "b")))]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names) - 1]
                columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def _kept(text: str, a: list[int] | None, b: list[int] | None) -> tuple[int, int, int, str, bytes]:
    data = text.encode()
    if not a:
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), data
    depth = np.zeros(len(data) + 1, np.int32)
    np.add.at(depth, np.array(a), 1)
    np.add.at(depth, np.array(b), -1)
    gone = np.cumsum(depth[:-1]) > 0
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept

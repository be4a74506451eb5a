"""Best-fit packing of token sequences by exact-complement hashing.

Only the number of pieces of each length matters for a plan, and there are at most ``capacity`` lengths, so
the plan is made from that histogram: for each length the index of sums of one, two and three available
lengths is asked for the exact gap, and combinations are used as often as the counts allow; what is left is
packed by best fit.  The plan says how often each pattern of lengths occurs.  Pieces are then numbered
within their length, by a distributed running sum, and look their place up in the plan.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import cut, running_sum, stored, text_of

CAPACITY = 1024
END = 2
BATCH = 4 << 20

#: Beyond these characters (the Latin blocks) the classes of letters may depend on a library's Unicode version.
_BEYOND = re.compile("[^\x00-ɏ]")
_SPECIAL = "<|endoftext|>"


@functools.lru_cache(4)
def encoder(name: str):
    """``ids(text)`` for a public tokenizer file (a name or a path).

    The vocabulary is the one of ``tokenizers``.  Where the same vocabulary is at hand as ranks, texts of
    Latin characters go through ``tiktoken``, which gives the same ids in a third of the time.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = name if os.path.exists(name) else public_tokenizers.path(name)
    exact = Tokenizer.from_file(path)
    ranks = re.sub(r"\.json$", ".tiktoken", path)
    if ranks == path or not os.path.exists(ranks):
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(text: str) -> list[int]:
        if _SPECIAL in text or not text.isascii() and _BEYOND.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def pieces(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): the whole text's ids and ``end``, cut from the back."""
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text_of(documents).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in batches:
            for batch in cut(whole, BATCH):
                out: list[list] = [[] for _ in names]
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = np.array([*encode(text), end], dtype="<u4")
                    start, stop, piece = 0, len(ids) % capacity or min(capacity, len(ids)), 0
                    while start < len(ids):
                        part = ids[start:stop]
                        for column, value in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part)):
                            column.append(value)
                        start, stop, piece = stop, stop + capacity, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(work, schema)


# -- the plan, from a histogram of at most ``capacity`` lengths --------------------------------


def _times(left: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often the available counts allow a combination."""
    return min(int(left[x]) // n for x, n in Counter(lengths).items())


def _complement(left: np.ndarray, first: int, gap: int, size: int) -> tuple[int, ...] | None:
    """``size`` (one to three) available lengths up to ``first`` that sum to ``gap``, large ones first."""
    if size == 1:
        return (gap,) if gap <= first and _times(left, (first, gap)) else None
    if size == 2:
        return _pair(left, (first,), gap, first)
    for x in range(min(first, gap - 2), (gap - 1) // 3, -1):
        if left[x] and _times(left, (first, x)):
            pair = _pair(left, (first, x), gap - x, x)
            if pair:
                return (x, *pair)
    return None


def _pair(left: np.ndarray, used: tuple[int, ...], gap: int, most: int) -> tuple[int, int] | None:
    """Two available lengths up to ``most`` that sum to ``gap``, beside those in use."""
    large = np.arange(min(most, gap - 1), (gap - 1) // 2, -1)
    for x in large[(left[large] > 0) & (left[gap - large] > 0)] if len(large) else ():
        if _times(left, (*used, int(x), gap - int(x))):
            return int(x), gap - int(x)
    return None


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; every piece is in one pattern.

    Exact combinations are used up by size: pairs of lengths over the whole histogram, then three, then
    four; the rest is best fit.  A large combination can use up lengths that best fit would need, so the
    plans that stop at two, three and four lengths are all made, and the shortest wins.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left[length] = count
    found: Counter = Counter({(capacity,): int(left[capacity])} if left[capacity] else {})
    left[capacity] = 0
    plans = []
    for size in (1, 2, 3):
        for first in range(capacity - 1, 0, -1):
            while left[first]:
                rest = _complement(left, first, capacity - first, size)
                if rest is None:
                    break
                pattern = (first, *rest)
                times = _times(left, pattern)
                for length in pattern:
                    left[length] -= times
                found[pattern] += times
        plans.append(found + _best_fit(left, capacity))
    return list(min(plans, key=lambda p: sum(p.values())).items())


def _best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Best fit, longest first, for whole groups of equal bins at a time."""
    bins: list[Counter] = [Counter() for _ in range(capacity + 1)]  # by gap: patterns and how many
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            gap = next((g for g in range(length, capacity + 1) if bins[g]), None)
            if gap is None:
                fit = min(capacity // length, count)
                times = count // fit
                pattern, taken = (length,) * fit, fit * times
                bins[capacity - fit * length][pattern] += times
            else:
                pattern, times = bins[gap].popitem()
                fit = min(gap // length, max(1, count // times))
                taken = min(times, count // fit)
                if taken < times:
                    bins[gap][pattern] += times - taken
                bins[gap - fit * length][pattern + (length,) * fit] += taken
                taken *= fit
            count -= taken
    return sum(bins, Counter())


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Look-up arrays sorted by length and first rank: pieces of a length fill its patterns in order of rank."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in sorted(patterns, reverse=True):
        offset = 0
        for length, fit in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, used[length], sequence, offset, fit))
            used[length] += fit * times
            offset += fit * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "fit": table[:, 4]}


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to stored pieces; any one length may hold most of them."""
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return cut_pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    table = places(plan(counts, capacity))  # bounded by the number of lengths, not of pieces
    key = F.md5(F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece", "ids_crc32"))
    keyed = cut_pieces.withColumn("_key", key).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sum(keyed, "length", "_key", ["doc_id", "piece", "ids_crc32"], "_one").drop("_key", "_one")
    ranked = ranked.select(*cut_pieces.columns, "before")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("before").to_numpy()
            at = np.searchsorted(table["key"], (length << 44) | rank, "right") - 1
            number = rank - table["rank"][at]
            sequence = table["sequence"][at] + number // table["fit"][at]
            offset = table["offset"][at] + number % table["fit"][at] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    return ranked.mapInArrow(work, f"{fields}, sequence_id long, offset long")


def pack(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) for every piece of every document.

    A document is the ids of its whole text and ``end``; one longer than ``capacity`` is cut so that only
    its first piece is shorter.  Null and empty texts are the one id ``end``.  Null ids and repeated rows are
    packed like others; an empty table gives no rows; other columns are ignored.
    """
    return place(stored(pieces(documents, tokenizer, capacity, end, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from packed pieces with ids: the training sequences."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

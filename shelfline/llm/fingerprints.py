"""Document fingerprints by consistent weighted sampling.

A text is a set of words (lower-cased A-Z, separated by ASCII white space) weighted by how often they occur.
For every sample and term two gamma variates and a uniform one, all functions of the term alone, give a
level of the weight and a value at that level; the term with the least value and its level are the sample.
Two texts draw the same sample with a probability that equals their generalised Jaccard similarity: the sum
of the smaller weights over the sum of the larger ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import by_batch, cut, partitions, stored, text_of

#: Samples of a fingerprint, each kept as 16 bits: other samples agree by chance once in 65,536 times.
SAMPLES = 128
#: Bytes of text that a task weighs at once.
TOGETHER = 16 << 20
#: Terms whose variates are drawn at once: they fit the processor's cache.
CHUNK = 1 << 14
_STEP = np.uint64(0x9E3779B97F4A7C15)

_ROW = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits for each of ``x`` (unsigned 64-bit numbers)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _variates(hashes: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``r``, ``log c`` and ``beta`` of a sample for each term: two gamma variates of shape 2 and a uniform one.

    Five numbers of 24 bits come from two hashes.
    """
    first, second = (_mixed(hashes + _STEP * np.uint64(2 * sample + i + 1)) for i in (0, 1))
    low = np.uint64((1 << 24) - 1)

    def part(x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)

    r = -np.log(part(first & low) * part((first >> np.uint64(24)) & low))
    c = -np.log(part(second & low) * part((second >> np.uint64(24)) & low))
    beta = part(((first >> np.uint64(48)) << np.uint64(8)) | (second >> np.uint64(56)))
    return r, np.log(c), beta


def weighted_samples(hashes: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int, samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit sample codes for each of ``n_rows`` weighted sets (zeros for an empty set).

    ``rows, terms, weights`` list the members, sorted by row; ``terms`` are places in ``hashes``, which
    are sorted, so that ties fall alike in every call.
    """
    out = np.zeros((n_rows, samples), np.uint16)
    if not len(rows):
        return out
    # a pair is a term and a weight: weight one by its term, the few others behind them
    other = weights != 1
    keys, back = np.unique((terms[other] << 32) | weights[other], return_inverse=True)
    pair = terms.copy()
    pair[other] = len(hashes) + back
    heavy = keys >> 32
    term_of = np.concatenate([np.arange(len(hashes)), heavy])
    log_weight = np.log((keys & 0xFFFFFFFF).astype(np.float32))
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    number = np.arange(len(term_of), dtype=np.uint64)
    value = np.empty(len(term_of), np.float32)
    level = np.zeros(len(term_of), np.int64)
    r, log_c, beta = (np.empty(len(hashes), np.float32) for _ in range(3))
    with np.errstate(over="ignore"):
        for j in range(samples):
            for at in range(0, len(hashes), CHUNK):
                part = slice(at, min(at + CHUNK, len(hashes)))
                r[part], log_c[part], beta[part] = _variates(hashes[part], j)
                value[part] = log_c[part] - r[part] * (1 - beta[part])  # the level of weight one is 0
            rise = np.floor(log_weight / r[heavy] + beta[heavy])
            value[len(hashes) :] = log_c[heavy] - r[heavy] * (rise - beta[heavy] + 1)
            level[len(hashes) :] = rise
            # the bits of a positive float order like it; the pair goes along in the lower half
            keyed = (np.exp(value).view(np.uint32).astype(np.uint64) << np.uint64(32)) | number
            won = (np.minimum.reduceat(keyed[pair], first) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            code = _mixed(hashes[term_of[won]] + _STEP * (level[won].view(np.uint64) + np.uint64(j)))
            out[rows[first], j] = (code >> np.uint64(48)).astype(np.uint16)
    return out


def signatures(texts: Sequence[str], samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """The sample codes of texts, and which of them have a word at all."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    at, flat = words.offsets.to_numpy(), words.values.slice(words.offsets[0].as_py(), words.offsets[-1].as_py() - words.offsets[0].as_py())
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.filter(pa.array(full)).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    # words of equal hash are one term
    hashes, rank = np.unique(hashes, return_inverse=True)
    row, code = row[full], rank[coded.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.zeros(0, np.int64)
    keys, weights = np.unique(row * max(1, len(hashes)) + code, return_counts=True)
    rows, terms = np.divmod(keys, max(1, len(hashes)))
    some = np.zeros(len(texts), bool)
    some[rows] = True
    return weighted_samples(hashes, rows, terms, weights, len(texts), samples), some


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """The share of equal samples; texts without words are alike, and unlike all others."""
    return np.where(some_a & some_b, (a == b).mean(axis=1), (some_a == some_b).astype(np.float64))


def raw(codes: np.ndarray, some: np.ndarray) -> list[bytes]:
    """Two bytes a sample; empty without words."""
    return [row.tobytes() if s else b"" for row, s in zip(codes.astype(">u2"), some)]


def shown(codes: np.ndarray, some: np.ndarray) -> list[str]:
    """Four hex digits a sample; empty without words."""
    return [row.hex() for row in raw(codes, some)]


def fingerprints(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, fingerprint`` for every row of ``documents``.

    A null text is empty; a text without words has the empty fingerprint.  Equal texts, repeated rows
    among them, have equal fingerprints; null ids stay null, very long texts are read whole, an empty
    table gives no rows and further columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown(*signatures(batch.column(1).to_pylist(), samples)))], ["doc_id", "fingerprint"])

    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text_of(documents).alias("text"))
    return by_batch(rows, work, "doc_id long, fingerprint string", TOGETHER)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of the next one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _finished(ids: list, texts: list[str], codes: np.ndarray, some: np.ndarray, after: list[str], next_codes: np.ndarray, next_some: np.ndarray) -> dict:
    """Result columns of documents whose next documents are known."""
    changed = [edited(t, f) for t, f in zip(texts, after)]
    new, new_some = signatures(changed)
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
        "fingerprint": pa.array(raw(codes, some), pa.binary()),
        "edited_fingerprint": pa.array(raw(new, new_some), pa.binary()),
        "near_edited": likeness(codes, some, new, new_some),
        "near_next": likeness(codes, some, next_codes, next_some),
    }


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per document.

    The edited text ends with the beginning of the next document in ascending order of ``doc_id``, nulls
    first; rows of one id follow in the order of a hash of their texts, and after the last comes the
    first.  Documents are range-partitioned and read in order, each with the one after it; only the
    first and last document of a partition, one each, meet in a second step.  A null text is empty,
    repeated rows are documents of their own, a single document is its own next one, very long texts
    are read whole, an empty table gives no rows and further columns are ignored.
    """
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text_of(documents).alias("text"))
    # hashes, not texts, break ties: the borders of the ranges are sampled to the driver
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    ranged = rows.repartitionByRange(partitions(documents.sparkSession), *order).sortWithinPartitions(*order)

    names = [c.split()[0] for c in _ROW.split(", ")]
    schema = f"{_ROW}, part int, edge string, text string"

    def batch_of(columns: dict, n: int, part: int) -> pa.RecordBatch:
        columns = {"part": pa.array([part] * n, pa.int32()), **columns}
        fields = [c.split() for c in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(columns[c], _TYPES[kind]) if c in columns else pa.nulls(n, _TYPES[kind]) for c, kind in fields], [c for c, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None  # the last document so far: it waits for the next one
        for batch in batches:
            for piece in cut(batch, TOGETHER):
                ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                if not texts:
                    continue
                codes, some = signatures(texts)
                if held is None:
                    yield batch_of({"edge": ["first"], "doc_id": ids[:1], "text": texts[:1]}, 1, part)
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                    codes, some = np.concatenate([held[2], codes]), np.concatenate([held[3], some])
                held = (ids[-1], texts[-1], codes[-1:], some[-1:])
                if len(texts) > 1:
                    done = _finished(ids[:-1], texts[:-1], codes[:-1], some[:-1], texts[1:], codes[1:], some[1:])
                    yield batch_of(done, len(texts) - 1, part)
        if held is not None:
            yield batch_of({"edge": ["last"], "doc_id": [held[0]], "text": [held[1]]}, 1, part)

    out = stored(ranged.mapInArrow(run, schema), "fingerprints")
    lasts = out.where("edge = 'last'").select("part", "doc_id", "text")
    firsts = out.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    # one row a partition that has documents
    every = Window.orderBy("part")
    turns = lasts.select("part", F.coalesce(F.lead("part").over(every), F.min("part").over(Window.partitionBy())).alias("next"))
    met = lasts.join(turns, "part").join(firsts, "next").select("doc_id", "text", "following")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, after = (c.to_pylist() for c in batch.columns)
        return pa.RecordBatch.from_pydict(_finished(ids, texts, *signatures(texts), after, *signatures(after)))

    done = out.where("edge is null").select(*names).unionByName(by_batch(met, work, _ROW, TOGETHER))
    # the digits are written out last: they take twice the room
    return done.select(*[F.lower(F.hex(c)).alias(c) if kind == "binary" else F.col(c) for c, kind in (f.split() for f in _ROW.split(", "))])

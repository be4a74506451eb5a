"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters, three such runs joined by dots, and values that are assigned to a
name, whole if they are quoted.  The forest sees their length, the transitions between character classes, how
much of them dictionary words cover, the path they stand in and the words beside them.  It is trained on
labelled findings; where the caller has none, rules label those candidates of the corpus itself that are clear
either way: by the name they are assigned to, by a public token format, or by harmless words.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import cut, hash_sample, kth_largest, stored, text_of

LEAST = 16
LEAST_ASSIGNED = 8
#: Bounds: words of the dictionary that travels with the tasks, and labelled findings that train the forest.
DICTIONARY = 20_000
LABELLED = 20_000
TREES, DEPTH = 40, 6
BATCH = 8 << 20

_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_QUOTED = re.compile(r"""[=:]\s{0,2}(?:"([^"\s]{8,})"|'([^'\s]{8,})')""")
_ASSIGNED = re.compile(rf"[=:]\s{{0,2}}([A-Za-z0-9+/_-]{{{LEAST_ASSIGNED},}}={{0,2}})")
_MIXED = re.compile("(?=.*[a-z])(?=.+[A-Z])")  # a capital at the start alone is a word
_WORDS = re.compile(r"[A-Za-z]+")
_PIECES = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
# How tokens of public services begin.
_FORMATS = re.compile(
    r"AKIA[A-Z0-9]{16}$|ASIA[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{20,}$|github_pat_[A-Za-z0-9_]{20,}$|glpat-[A-Za-z0-9_-]{20,}$"
    r"|sk_live_[A-Za-z0-9]{16,}$|sk-[A-Za-z0-9_-]{20,}$|xox[abprs]-[A-Za-z0-9-]{10,}$|AIza[A-Za-z0-9_-]{30,}$|npm_[A-Za-z0-9]{20,}$|eyJ[A-Za-z0-9_-]+\.eyJ"
)
_BEFORE = re.compile(r"([A-Za-z0-9_.-]*)[\"']?\s{0,2}([=:])?\s{0,2}[\"']?$")

# Words that speak for and against a secret beside a candidate, and of paths.
SECRET_WORDS = frozenset("token secret key apikey password passwd pwd auth credential credentials private access bearer signature".split())
HARMLESS_WORDS = frozenset("hash sha md5 commit checksum digest uuid guid id example sample dummy placeholder version test phone card order".split())
TEST_PATHS = frozenset("test tests example examples sample samples mock mocks fixture fixtures doc docs demo".split())
CONFIG_PATHS = frozenset("config conf settings env secrets credentials deploy ini yml yaml properties toml".split())

_CLASSES = "luds"  # lower, upper, digit, sign
#: Neighbouring words are counted by hash as well, so that the forest can learn others than the fixed ones.
BUCKETS = 12
FEATURES = (
    ["length", "entropy", "digits", "hex", "kinds", "coverage", "longest_word", "assigned", "quoted"]
    + [f"{a}{b}" for a in _CLASSES for b in _CLASSES]
    + ["secret_before", "secret_after", "harmless_before", "harmless_after", "named_secret", "format", "test_path", "config_path", "path_depth"]
    + [f"{side}{i}" for side in ("before", "after") for i in range(BUCKETS)]
)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans in order, without overlap.

    Assigned quoted values come first, then dotted runs, then runs of ``LEAST`` and more with a digit or a capital
    among small letters, then shorter assigned values.  Equals signs only end a run: the name before one is not
    part of it.
    """
    found: list[tuple[int, int]] = []

    def add(spans: list[tuple[int, int]]) -> None:
        nonlocal found
        free, at = [], 0
        for start, end in spans:
            while at < len(found) and found[at][1] <= start:
                at += 1
            if at == len(found) or end <= found[at][0]:
                free.append((start, end))
        found = sorted([*found, *free])

    add([m.span(1) if m[1] is not None else m.span(2) for m in _QUOTED.finditer(text)])
    add([m.span() for m in _DOTTED.finditer(text)])
    runs = []
    for m in _RUN.finditer(text):
        start = m.start()
        while start < m.end() and text[start] in "-_/+":  # a separator in front is no part of the value
            start += 1
        value = text[start : m.end()]
        if len(value) >= LEAST and (any(c.isdigit() for c in value) or _MIXED.match(value)):
            runs.append((start, m.end()))
    add(runs)
    add([m.span(1) for m in _ASSIGNED.finditer(text)])
    return found


def _kind(c: str) -> str:
    return "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s"


def describe(text: str, start: int, end: int, path: str, words: frozenset[str]) -> list[float]:
    """The features of a candidate, in the order of ``FEATURES``."""
    value = text[start:end]
    n = len(value)
    counts = Counter(value)
    kinds = [_kind(c) for c in value]
    pairs = Counter(zip(kinds, kinds[1:]))
    known = [p for p in _PIECES.findall(value) if p.lower() in words]
    before, after = text[max(0, start - 120) : start], text[end : end + 80]
    link = _BEFORE.search(before)
    name = {w.lower() for w in _WORDS.findall(link.group(1))} if link and link.group(2) else set()
    left, right = ({w.lower() for w in ws} for ws in (_WORDS.findall(before)[-5:], _WORDS.findall(after)[:5]))
    places = {w.lower() for w in _WORDS.findall(path)}
    return [
        float(n),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        kinds.count("d") / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        float(len(set(kinds))),
        sum(map(len, known)) / n,
        float(max(map(len, known), default=0)),
        float(bool(link and link.group(2))),
        float(before[-1:] in ("'", '"') and after[:1] == before[-1:]),
        *[pairs[a, b] / max(1, n - 1) for a in _CLASSES for b in _CLASSES],
        float(len(left & SECRET_WORDS)),
        float(len(right & SECRET_WORDS)),
        float(len(left & HARMLESS_WORDS)),
        float(len(right & HARMLESS_WORDS)),
        float(bool(name & SECRET_WORDS)),
        float(bool(_FORMATS.match(value))),
        float(bool(places & TEST_PATHS)),
        float(bool(places & CONFIG_PATHS)),
        float(path.count("/")),
        *_hashed(left),
        *_hashed(right),
    ]


def _hashed(words: set[str]) -> list[float]:
    out = [0.0] * BUCKETS
    for w in words:
        out[zlib.crc32(w.encode()) % BUCKETS] += 1
    return out


def clear_label(features: list[float]) -> int | None:
    """1, 0 or (not clear) None for a candidate of which no finding is known."""
    f = dict(zip(FEATURES, features))
    named = f["named_secret"] and f["assigned"] and f["entropy"] >= 3 and f["coverage"] < 0.3 and f["length"] >= (12 if f["quoted"] else 20)
    # a name or a format speaks louder than a harmless word nearby; in a test it is not clear
    if named or f["format"]:
        return None if f["test_path"] else 1
    if f["test_path"] or f["harmless_before"] and not f["named_secret"]:
        return 0
    if not f["secret_before"] and (f["digits"] == 1 or f["coverage"] > 0.5 or f["entropy"] < 2.5 or not f["assigned"]):
        return 0
    return None


def dictionary(documents: DataFrame, size: int = DICTIONARY) -> frozenset[str]:
    """The words that occur most often, counted over all texts: at most ``size``, those above the first one left out."""
    words = F.explode(F.split(F.lower(text_of(documents)), "[^a-z]+"))
    counted = documents.select(words.alias("w")).where(F.length("w").between(3, 24)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # a word that occurs once in a large corpus is none of them, and most are like that
    counted = stored(counted.where("n > 1"), "secret-words")
    least = kth_largest(counted, "n", size + 1)
    return frozenset(r["w"] for r in counted.where(F.col("n") > least).select("w").collect())


def findings(documents: DataFrame, path: str = "source", words: frozenset[str] | None = None) -> DataFrame:
    """``doc_id, start, end, value_sha256, features, label``: all candidates; values are never written."""
    words = dictionary(documents) if words is None else words
    has_path = path in documents.columns
    place = F.coalesce(documents[path].cast("string"), F.lit("")) if has_path else F.lit("")
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text_of(documents).alias("text"), place.alias("path"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, BATCH):
                out = []
                for doc_id, text, where in zip(*(c.to_pylist() for c in batch.columns)):
                    for a, b in candidates(text):
                        f = describe(text, a, b, where, words)
                        out.append((doc_id, a, b, hashlib.sha256(text[a:b].encode()).hexdigest(), f, clear_label(f)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32())
                columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "value_sha256", "features", "label"])

    return rows.mapInArrow(work, "doc_id long, start long, end long, value_sha256 string, features array<double>, label int")


def train(labelled: DataFrame, rows: int = LABELLED, seed: int = 7):
    """A forest from ``features, label`` rows, at most ``rows`` distinct ones, half for each label if there are so many.

    A vector that occurs often is one row with a larger weight (the logarithm of its count), so that copies of
    one finding neither fill the sample nor fall out of it.  ``None`` if not both labels occur.
    """
    known = labelled.where("label is not null").select("features", F.col("label").cast("double").alias("label"))
    known = stored(known.groupBy("features", "label").agg(F.log2(F.count(F.lit(1)) + 1).alias("weight")), "secret-vectors")
    sample = hash_sample(known.where("label = 1"), ["features"], rows // 2).unionByName(hash_sample(known.where("label = 0"), ["features"], rows // 2))
    # one task's worth of rows by the limit; written, as the forest reads it once for each level of depth
    sample = stored(sample.select(array_to_vector("features").alias("x"), "label", "weight"), "secret-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", probabilityCol="shares", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return forest.fit(sample)


def scan(documents: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """``doc_id, start, end, value_sha256, probability, secret``: every candidate of every whole text.

    ``labelled``: findings with ``features, label``; without, the clear candidates of the documents.
    Places are code points, end exclusive.  Null and empty texts have no candidates; a run is one candidate
    whatever its length; null ids stay; repeated rows are scanned each; an empty table gives no rows; a
    missing path column counts as an empty path and other columns are ignored.  With labels of one kind
    only (or none) there is nothing to learn: the probability is that label, or 0.5, and those count as secret.
    """
    found = stored(findings(documents, path), "secret-findings")
    forest = train(found if labelled is None else labelled)
    if forest is None:
        only = F.coalesce(F.col("label").cast("double"), F.lit(0.5))
        rated = found.withColumn("probability", only)
    else:
        rated = forest.transform(found.drop("label").withColumn("x", array_to_vector("features")))
        rated = rated.withColumn("probability", vector_to_array("shares")[1])
    return rated.select("doc_id", "start", "end", "value_sha256", "probability", (F.col("probability") >= threshold).alias("secret"))

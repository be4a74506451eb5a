"""Document tables: change detection, section split, chunk packing and API specifications."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfline.functions.chunking import ChunkRules, Words, chunks, outline
from shelfline.operators.scale import salted_join
from shelfline.sources import versions

SOURCE_KEY = ("source_type", "source_path")
#: Bytes of text that a task hands to a model at once, and those that it cuts at once: their tokens and
#: slices are Python objects of several times the size, and what a worker once held it keeps.
TEXT_BYTES, CUT_BYTES = 16 << 20, 1 << 20


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def detect_changes(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents (source key, content) against stored sources (source key, source_id, content_hash).

    ``status``: unchanged for an equal hash, updated for a known source, else indexed.
    """
    return detect_changed_hashes(documents.withColumn("content_hash", content_hash(F.col("content"))), sources)


def detect_changed_hashes(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """``detect_changes`` for documents that carry their ``content_hash``; they need no text."""
    keys = list(SOURCE_KEY)
    known = sources.select(*keys, "source_id", F.col("content_hash").alias("_stored"), F.lit(True).alias("_known"))
    status = (
        F.when(F.col("_stored") == F.col("content_hash"), "unchanged")
        .when(F.col("_known"), "updated")
        .otherwise("indexed")
    )
    return documents.join(known, keys, "left").withColumn("status", status).drop("_stored", "_known")


def replace_chunks(chunks: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks after a run: those of the sources in ``gone`` (updated or deleted) leave, ``fresh`` ones enter."""
    ids = gone.select("source_id").distinct()
    kept = salted_join(chunks, ids, ["source_id"], "left_anti", spread=["chunk_index"])
    return kept.unionByName(fresh.select(*chunks.columns))


def replace_chunks_in(path: str, fresh: DataFrame, gone: DataFrame, layout: versions.Layout) -> versions.Version:
    """``replace_chunks`` in a stored table that is laid out by ``source_id``: only the touched buckets are rewritten."""
    spark = fresh.sparkSession
    before = versions.current(spark, path)
    values = versions.touched(fresh.select("source_id").unionByName(gone.select("source_id")), layout)
    chunks = versions.read(spark, path, layout, values, before)
    return versions.replace(replace_chunks(chunks, fresh, gone), path, layout, values, before)


def source_overview(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources with their number of chunks and tokens; sources without chunks have 0."""
    sizes = chunks.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum("token_count").cast("long").alias("token_total")
    )
    return sources.join(sizes, "source_id", "left").fillna(0, ["chunk_count", "token_total"])


def token_totals(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    return chunks.groupBy(*by).agg(F.sum("token_count").cast("long").alias("tokens_processed"))


# -- markdown ---------------------------------------------------------------------

def _small(batch: pa.RecordBatch, size: int = CUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Halves of a batch, until each has few bytes or one row: texts may be of any length."""
    if batch.num_rows <= 1 or batch.nbytes <= size:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _small(batch.slice(0, half), size)
        yield from _small(batch.slice(half), size)


def _slices(documents: DataFrame, columns: str, work) -> DataFrame:
    """Rows that ``work`` makes of each text, next to the other columns; texts never leave their task."""
    names = documents.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(i, r) for i, t in enumerate(batch.column(len(names) - 1)) if t.is_valid for r in work(t.as_py())]
        rows = pa.array([i for i, _ in found], pa.int64())
        made = [pa.array([r[c] for _, r in found], kind) for c, kind in enumerate(kinds)]
        kept = [batch.column(i).take(rows) for i in range(len(names) - 1)]
        return pa.RecordBatch.from_arrays([*kept, *made], [f.name for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield from map(cut, _small(whole))
            del whole  # before the next one is read

    made_type = T._parse_datatype_string(columns)
    kinds = [to_arrow_type(f.dataType) for f in made_type]
    schema = T.StructType([*documents.schema.fields[:-1], *made_type])
    return documents.mapInArrow(run, schema)


def split_sections(documents: DataFrame, text: str = "content") -> DataFrame:
    """One row per section with its 0-based ``section_index``, ``path``, ``heading``, ``level``, ``content``.

    Linear in the text: no shuffle, and no window over lines.  The text ends with a line feed.
    """
    rest = [c for c in documents.columns if c != text]

    def work(content: str):
        content += "\n"
        for i, s in enumerate(outline(content)):
            yield i, list(s.path), s.heading, s.level, content[s.start : s.end]

    columns = "section_index int, path array<string>, heading string, level int, content string"
    return _slices(documents.select(*rest, F.col(text).alias("_text")), columns, work)


def pack_chunks(
    documents: DataFrame, key: str, text: str = "content", rules: ChunkRules = ChunkRules(), tokens=None
) -> DataFrame:
    """Chunks of every document: key, chunk_index, content, token_count, heading, section_path.

    Every token of a text is the new text of exactly one chunk.  ``heading`` and ``section_path`` are
    those where the new text starts.  Null and blank texts have no chunks.
    """
    tokens = tokens or Words()

    def work(content: str):
        for i, (path, part, count) in enumerate(chunks(content, rules, tokens)):
            yield i, part, count, path[-1] if path else None, list(path)

    columns = "chunk_index int, content string, token_count int, heading string, section_path array<string>"
    return _slices(documents.select(key, F.col(text).alias("_text")), columns, work)


# -- API specifications -----------------------------------------------------------------

_SPEC = (
    "info struct<title:string,version:string,description:string>,"
    "servers array<struct<url:string,description:string>>,"
    "paths map<string,map<string,string>>"
)
_OPERATION = (
    "operationId string, summary string, description string, tags array<string>,"
    "parameters array<struct<name:string,`in`:string,required:boolean,description:string>>,"
    "requestBody struct<content:map<string,struct<schema:string>>>,"
    "responses map<string,struct<description:string>>"
)


def _lines(*parts: Column) -> Column:
    """The parts that are not NULL, one below the other."""
    return F.concat_ws("\n", *parts)


def _some(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text)


def _listed(title: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n### {title}\n"), F.array_join(items, "\n")))


def spec_chunks(documents: DataFrame, key: str, text: str = "content") -> DataFrame:
    """JSON API specifications to one info row and one row per path and method.

    Methods that start with ``x-`` or are no objects are left out.  Schema references are not resolved.
    Documents that are no specification (no JSON, or neither info nor paths) are packed as markdown, as
    rows of type ``text``; only null and blank ones have no row.
    """
    parsed = documents.select(F.col(key), F.from_json(F.col(text), _SPEC).alias("_d")).select(key, "_d.*")
    blank = F.lit("")
    has_info = F.coalesce(
        F.col("info.title").isNotNull() | F.col("info.version").isNotNull() | F.col("info.description").isNotNull(),
        F.lit(False),
    )
    title = F.coalesce(F.col("info.title"), F.lit("API"))
    servers = F.transform(
        "servers",
        lambda s: F.concat(
            F.lit("- "),
            F.coalesce(s["url"], blank),
            F.when(F.coalesce(s["description"], blank) != "", F.concat(F.lit(" ("), s["description"], F.lit(")"))).otherwise(blank),
        ),
    )
    overview = _lines(
        F.concat(F.lit("# "), title),
        F.when(F.coalesce(F.col("info.version"), blank) != "", F.concat(F.lit("Version: "), F.col("info.version"))),
        F.when(F.coalesce(F.col("info.description"), blank) != "", F.concat(F.lit("\n"), F.col("info.description"))),
        F.when(F.size("servers") > 0, F.concat(F.lit("\n## Servers\n"), F.array_join(servers, "\n"))),
    )
    wanted = lambda m: ~m["key"].startswith("x-") & F.coalesce(m["value"].startswith("{"), F.lit(False))
    call = "struct<path:string,method:string,body:string>"
    calls = F.flatten(
        F.transform(
            F.map_entries("paths"),
            lambda p: F.transform(
                F.filter(F.map_entries(F.coalesce(p["value"], F.create_map().cast("map<string,string>"))), wanted),
                lambda m: F.struct(p["key"].alias("path"), m["key"].alias("method"), m["value"].alias("body")),
            ),
        )
    )
    nothing = F.lit(None).cast("string")
    # the info row is an entry without a path in front of the calls: one pass over the documents
    head = F.when(has_info, F.array(F.struct(nothing.alias("path"), nothing.alias("method"), nothing.alias("body"))))
    entries = F.concat(F.coalesce(head, F.array().cast(f"array<{call}>")), F.coalesce(calls, F.array().cast(f"array<{call}>")))
    plain = documents.withColumn("_d", F.from_json(F.col(text), _SPEC))
    plain = plain.where(F.col("_d.info").isNull() & F.col("_d.paths").isNull()).select(key, F.col(text).alias("content"))
    others = pack_chunks(plain, key).select(
        key, "chunk_index", F.lit("text").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("path", "method", "operation_id", "summary")],
        F.lit(None).cast("array<string>").alias("tags"), "content",
    )
    rows = parsed.select(key, overview.alias("_overview"), F.posexplode(entries).alias("chunk_index", "_c")).select(
        key, "chunk_index", "_overview", "_c.path", "_c.method", F.from_json("_c.body", _OPERATION).alias("_o")
    )
    o = F.col("_o")
    params = F.transform(
        o["parameters"],
        lambda p: F.concat(
            F.lit("- `"), F.coalesce(p["name"], blank), F.lit("` ("), F.coalesce(p["in"], blank), F.lit(")"),
            F.when(p["required"], F.lit(" (required)")).otherwise(blank), F.lit(": "), F.coalesce(p["description"], blank),
        ),
    )
    answers = F.transform(
        F.map_entries(o["responses"]),
        lambda a: F.concat(F.lit("- **"), a["key"], F.lit("**: "), F.coalesce(a["value"]["description"], blank)),
    )
    bodies = F.transform(
        F.map_entries(o["requestBody"]["content"]),
        lambda e: F.concat(
            F.lit("Content-Type: "), e["key"],
            F.coalesce(F.concat(F.lit("\n```json\n"), e["value"]["schema"], F.lit("\n```")), blank),
        ),
    )
    endpoint = _lines(
        F.concat(F.lit("## "), F.upper("method"), F.lit(" "), F.col("path")),
        F.concat(F.lit("**"), _some(o["summary"]), F.lit("**")),
        F.concat(F.lit("\n"), _some(o["description"])),
        F.when(F.size(o["tags"]) > 0, F.concat(F.lit("\nTags: "), F.array_join(o["tags"], ", "))),
        _listed("Parameters", params),
        _listed("Request Body", bodies),
        _listed("Responses", answers),
    )
    is_call = F.col("path").isNotNull()
    specified = rows.select(
        key,
        "chunk_index",
        F.when(is_call, "endpoint").otherwise("api_info").alias("type"),
        "path",
        F.upper("method").alias("method"),
        F.coalesce(o["operationId"], F.concat("method", F.lit("_"), "path")).alias("operation_id"),
        o["summary"].alias("summary"),
        F.when(is_call, F.coalesce(o["tags"], F.array().cast("array<string>"))).alias("tags"),
        F.when(is_call, endpoint).otherwise(F.col("_overview")).alias("content"),
    )
    return specified.unionByName(others)


# -- embeddings ---------------------------------------------------------------------------


class EmbeddingProvider(ABC):
    """A user model that turns texts into vectors, in the order of the texts."""

    max_tokens: int = 8191
    batch_size: int = 100

    @property
    @abstractmethod
    def dimension(self) -> int: ...

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def _runs(texts: list[str], size: int = TEXT_BYTES) -> Iterator[list[str]]:
    """Texts in order, some at a time: about ``size`` characters or one text."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text) > size:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def embed(rows: DataFrame, provider: EmbeddingProvider, text: str = "content", tokens=None) -> DataFrame:
    """``embedding`` for every row.

    A text above the token limit of the provider is embedded in parts of that size, and the vectors are
    averaged by their tokens.
    """
    tokens = tokens or Words()

    def parts(content: str) -> list[tuple[str, int]]:
        spans = tokens.spans(content)
        if len(spans) <= provider.max_tokens:
            return [(content, max(1, len(spans)))]
        cut = (spans[i : i + provider.max_tokens] for i in range(0, len(spans), provider.max_tokens))
        return [(content[p[0][0] : p[-1][1]], len(p)) for p in cut]

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            pooled: list[list[float]] = []
            for some in _runs(texts.fillna("").tolist()):
                cut = [parts(t) for t in some]
                flat = [p for ps in cut for p, _ in ps]
                out: list[list[float]] = []
                for start in range(0, len(flat), provider.batch_size):
                    out.extend(provider.embed(flat[start : start + provider.batch_size]))
                if any(len(v) != provider.dimension for v in out):
                    raise ValueError(f"provider did not return {provider.dimension} values per text")
                made = iter(out)
                pooled += [np.average([next(made) for _ in ps], axis=0, weights=[n for _, n in ps]).tolist() for ps in cut]
            yield pd.Series(pooled, index=texts.index, dtype=object)

    return rows.withColumn("embedding", vectors(F.col(text)))

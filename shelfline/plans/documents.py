"""Registered queries: documents, retrieval and the model-run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.operators import documents as docs
from shelfline.operators import filters, retrieval, runs
from shelfline.operators.scale import new_path
from shelfline.plans.common import num, r, rounded
from shelfline.plans.views import with_views
from shelfline.sources import versions
from shelfline.sources.star import load_star, read_table
from shelfline.streaming import changes as stream_changes

# -- documents ------------------------------------------------------------------


def _documents(spark, folder):
    return read_table(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("source_type"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("source_path"),
        F.col("text").alias("content"),
        "n_chars",
    )


def content_hashes(spark, folder):
    return _documents(spark, folder).select("doc_id", docs.content_hash(F.col("content")).alias("content_hash"))


def _stored(spark, folder):
    """The index before the run: long documents only, French ones in an older form."""
    d = _documents(spark, folder).where(F.col("n_chars") > 500)
    old = F.when(F.col("source_path").startswith("fr/"), F.concat("content", F.lit(" "))).otherwise(F.col("content"))
    return d.select(
        "source_type",
        "source_path",
        F.concat(F.lit("src-"), F.col("doc_id").cast("string")).alias("source_id"),
        docs.content_hash(old).alias("content_hash"),
    )


def changes(spark, folder):
    out = docs.detect_changes(_documents(spark, folder), _stored(spark, folder))
    return out.select("doc_id", "source_type", "source_path", "source_id", "status")


def change_stream(spark, folder):
    """Three runs of a stream over all documents: the stored ones, all as they are now, German ones changed again."""
    current = _documents(spark, folder)
    french = F.when(F.col("source_path").startswith("fr/"), F.concat("content", F.lit(" "))).otherwise(F.col("content"))
    german = F.when(F.col("source_path").startswith("de/"), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    rounds = (current.where(F.col("n_chars") > 500).withColumn("content", french), current, current.withColumn("content", german))
    incoming, state, log, marks = (new_path(spark, f"changes-{name}") for name in ("in", "state", "log", "marks"))
    stream_changes.create_state(spark, state, buckets=8)
    for rows in rounds:
        rows = rows.select("source_type", "source_path", "content", F.col("doc_id").alias("row_index"))
        rows.write.mode("append").option("compression", stream_changes.TEXT_CODEC).parquet(incoming)
        stream = spark.readStream.schema(rows.schema).parquet(incoming)
        stream_changes.start_change_detection(stream, state, log, marks, buckets=8).awaitTermination()
    return stream_changes.judged_documents(spark, log, state, ["source_type", "source_path", "status"]).drop("stream")


def _outlines(spark, folder):
    """Pages as markdown: title, headline and list items become headings of level 1 to 3."""
    html = F.col("html")
    for pattern, to in (
        ("<title>", "\n# "), ("</title>", "\n"), ("<h1>", "\n## "), ("</h1>", "\n"), ("<li>", "\n### "), ("<p>", "\n\n"),
    ):
        html = F.replace(html, F.lit(pattern), F.lit(to))
    return read_table(spark, folder, "pages").select("page_id", html.alias("content"))


def page_sections(spark, folder):
    out = docs.split_sections(_outlines(spark, folder))
    return out.select(
        "page_id", "section_index", F.array_join("path", " > ").alias("path"), "heading", "level", "content"
    )


def _joined_path(chunks):
    return chunks.withColumn("section_path", F.array_join("section_path", " > "))


def document_chunks(spark, folder):
    return _joined_path(docs.pack_chunks(_documents(spark, folder), "doc_id"))


def page_chunks(spark, folder):
    return _joined_path(docs.pack_chunks(_outlines(spark, folder), "page_id"))


def _chunk_rows(spark, folder):
    """One chunk per paragraph of each document, with plain SQL functions."""
    parts = F.posexplode(F.split("content", "\n"))
    return (
        _documents(spark, folder)
        .select("doc_id", "source_type", "source_path", parts.alias("chunk_index", "content"))
        .withColumn("source_id", F.concat(F.lit("src-"), F.col("doc_id").cast("string")))
        .withColumn("token_count", F.size(F.split("content", " ")))
    )


def _replaced_chunks(spark, folder, replace):
    columns = ["source_id", "chunk_index", "content"]
    every = _chunk_rows(spark, folder)
    stored = _stored(spark, folder).select("source_id")
    old = every.join(stored, "source_id", "left_semi").select(*columns)
    status = docs.detect_changes(_documents(spark, folder), _stored(spark, folder))
    changed = status.where(F.col("status") != "unchanged").select(
        F.concat(F.lit("src-"), F.col("doc_id").cast("string")).alias("source_id")
    )
    fresh = every.join(changed, "source_id", "left_semi").select(
        "source_id", "chunk_index", F.upper("content").alias("content")
    )
    return replace(old, fresh, changed).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("content") == F.upper("content")).alias("upper_chunks")
    )


def replaced_chunks(spark, folder):
    """Chunks per source after a run: changed sources re-chunked, their old chunks gone."""
    return _replaced_chunks(spark, folder, docs.replace_chunks)


def replaced_chunks_in_buckets(spark, folder):
    """The same in a stored table, bucket by bucket."""

    def replace(old, fresh, changed):
        layout, path = versions.by_bucket(["source_id"], 16), new_path(spark, "chunks")
        versions.create(old, path, layout)
        return versions.read(spark, path, layout, version=docs.replace_chunks_in(path, fresh, changed, layout))

    return _replaced_chunks(spark, folder, replace)


def source_overview(spark, folder):
    """Every document, and for each language a source that was registered but never indexed."""
    d = _documents(spark, folder)
    sources = d.select(
        F.concat(F.lit("src-"), F.col("doc_id").cast("string")).alias("source_id"), "source_type", "source_path"
    )
    lang = F.substring_index("source_path", "/", 1)
    new = d.select(F.concat(F.lit("new-"), lang).alias("source_id"), lang.alias("source_type"), lang.alias("source_path"))
    return docs.source_overview(sources.unionByName(new.distinct()), _chunk_rows(spark, folder))


def token_totals(spark, folder):
    return docs.token_totals(_chunk_rows(spark, folder), ["source_type"])


def _specs(spark, folder):
    """One API specification per product."""
    part = read_table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    spec = text(
        '{"info":{"title":', quoted(F.col("p_name")), ',"version":"1.0"},"servers":[{"url":"https://', F.col("p_brand"),
        '"}],"paths":{"/parts/', key, '":{"get":{"operationId":"read_', key, '","summary":', quoted(F.col("p_type")),
        ',"tags":["parts",', quoted(F.col("p_brand")), '],"parameters":[{"name":"id","in":"path","required":true,"description":"key"}],',
        '"responses":{"200":{"description":"found"},"404":{"description":"none"}}},"x-owner":{"name":"team"},',
        '"delete":{"description":"Removes it"}},"/size":{"post":{"summary":"Size ', F.col("p_size").cast("string"),
        '"},"parameters":[]}}}',
    )
    return part.select("p_partkey", spec.alias("content"))


def spec_chunks(spark, folder):
    out = docs.spec_chunks(_specs(spark, folder), "p_partkey")
    return out.withColumn("tags", F.array_join("tags", ","))


class TextShape(docs.EmbeddingProvider):
    """A stand-in provider: characters, words and lines of a text."""

    dimension = 3
    max_tokens = 10**9

    def embed(self, texts):
        return [[float(len(t)), float(len(t.split(" "))), float(t.count("\n") + 1)] for t in texts]


def embedded(spark, folder):
    out = docs.embed(_documents(spark, folder), TextShape())
    cell = lambda i: F.col("embedding")[i].cast("long")
    return out.select("doc_id", cell(0).alias("chars"), cell(1).alias("words"), cell(2).alias("lines"))


# -- retrieval ----------------------------------------------------------------------


def _described(spark, folder):
    """Vectors; the label is source type and category."""
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        "embedding",
        F.concat(F.lit("type"), F.col("label").cast("string")).alias("source_type"),
        F.concat(F.lit('{"category":"c'), (F.col("label") % 3).cast("string"), F.lit('"}')).alias("metadata"),
    )


def _chunks(spark, folder):
    """``_described`` with the document of the same number as text."""
    text = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_path"), F.col("text").alias("content")
    )
    return _described(spark, folder).join(text, "chunk_id", "left")


def _queries(spark, folder):
    """The first vector of each label."""
    vectors = read_table(spark, folder, "embeddings")
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return vectors.join(first.select("vec_id"), "vec_id", "left_semi").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )


def nearest(spark, folder):
    return retrieval.top_k(
        _vectors(spark, folder), _queries(spark, folder).where("query_id = 0"), k=10, threshold=0.1
    )


def _vectors(spark, folder):
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def nearest_many(spark, folder):
    return retrieval.top_k(_vectors(spark, folder), _queries(spark, folder), k=7, threshold=0.2)


def nearest_blocks(spark, folder):
    """The same by parts of the chunks, with the queries in blocks of three."""
    return retrieval.top_k(_vectors(spark, folder), _queries(spark, folder), k=7, threshold=0.2, block=3, few=2)


def nearest_filtered(spark, folder):
    chunks = _described(spark, folder)
    chunks = filters.member_of(chunks, "source_type", ["type1", "type3", "type4", "type7"])
    chunks = filters.json_equals(chunks, "metadata", "category", "c1")
    return retrieval.top_k(chunks, _queries(spark, folder), k=5, threshold=0.0)


def similarity_scan(spark, folder):
    """Similarity of every vector to vector 0, computed by Spark's own array functions."""
    vectors = read_table(spark, folder, "embeddings")
    query = vectors.where("vec_id = 0").select("embedding").scalar()
    paired = vectors.withColumn("query", query)
    return paired.select("vec_id", num(retrieval.cosine(F.col("embedding"), F.col("query"))).alias("similarity"))


def citations(spark, folder):
    hits = retrieval.top_k(_chunks(spark, folder), _queries(spark, folder), k=5, threshold=0.2)
    return retrieval.citations(hits, _chunks(spark, folder))


def evidence(spark, folder):
    queries = _queries(spark, folder)
    hits = retrieval.top_k(_vectors(spark, folder), queries, k=3, threshold=0.25)
    out = retrieval.sufficient_evidence(hits, queries, min_results=2, min_relevance=0.5)
    return rounded(out, "mean_relevance", digits=3)


# -- run log -----------------------------------------------------------------------------


def run_page(spark, folder):
    out = runs.list_runs(
        load_star(spark, folder).model_run, page=3, size=50, model_type="naive", status="success", store_id=4
    )
    return rounded(out.drop("created_at"), "mae")


def run_config_hashes(spark, folder):
    key = F.col("o_orderkey")
    config = F.create_map(
        F.lit("window"), (key % 4).cast("string"),
        F.lit("model"), F.concat(F.lit('"m'), (key % 3).cast("string"), F.lit('"')),
        F.lit("alpha"), F.lit("null"),
    )
    orders = read_table(spark, folder, "orders")
    return orders.select("o_orderkey", runs.config_hash_column(config).alias("config_hash"))


def duplicate_runs(spark, folder):
    return runs.duplicate_groups(load_star(spark, folder).model_run)


def duplicate_flags(spark, folder):
    marked = runs.apply_duplicate_policy(load_star(spark, folder).model_run, "detect")
    return marked.select("run_id", "duplicate_of")


def duplicates_denied(spark, folder):
    kept = runs.apply_duplicate_policy(load_star(spark, folder).model_run, "deny")
    return kept.groupBy("status", "model_type").agg(F.count(F.lit(1)).alias("runs"))


def transitions(spark, folder):
    """Orders of a customer as the status history of one run."""
    orders = read_table(spark, folder, "orders")
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("pending", "running", "success", "failed", "archived")]),
        (F.col("o_orderkey") % 5 + 1).cast("int"),
    )
    events = orders.select(
        F.col("o_custkey").alias("run_id"),
        status.alias("status"),
        # a day plus the key in microseconds: no two events of a run at the same time
        (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, cast(o_orderkey / 1000000 as decimal(18,6)))")).alias("at"),
    )
    return runs.transition_audit(events).select("run_id", "at", "from_status", "status", "allowed")


def _configured_runs(spark, folder):
    key = F.col("o_orderkey")
    base = F.create_map(
        F.lit("model"), (key % 3).cast("string"), F.lit("window"), (key % 4).cast("string"), F.lit("seed"), F.lit("42")
    )
    season = F.when(key % 3 == 1, F.create_map(F.lit("season"), F.lit("7"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    mae = F.create_map(F.lit("mae"), (F.col("o_totalprice") / 1000).cast("double"))
    wape = F.when(key % 2 == 0, F.create_map(F.lit("wape"), (key % 100).cast("double"))).otherwise(
        F.create_map().cast("map<string,double>")
    )
    return read_table(spark, folder, "orders").select(
        key.alias("run_id"), F.map_concat(base, season).alias("config"), F.map_concat(mae, wape).alias("metrics")
    )


def _pairs(spark, folder):
    """Every run and the one after it."""
    key = F.col("o_orderkey")
    return read_table(spark, folder, "orders").select(key.alias("run_a"), (key + 1).alias("run_b"))


def config_diffs(spark, folder):
    return runs.config_diff(_pairs(spark, folder), _configured_runs(spark, folder))


def metric_diffs(spark, folder):
    return rounded(runs.metric_diff(_pairs(spark, folder), _configured_runs(spark, folder)), "a", "b", "diff")


def _assignments(spark, folder):
    key = F.col("o_orderkey")
    return read_table(spark, folder, "orders").select(
        F.concat(F.lit("alias-"), (F.col("o_custkey") % 100).cast("string")).alias("alias_name"),
        F.md5(key.cast("string")).alias("run_id"),
        key.alias("at"),
    )


def alias_table(spark, folder):
    return runs.alias_table(_assignments(spark, folder), load_star(spark, folder).model_run)


def resolved_aliases(spark, folder):
    log = load_star(spark, folder).model_run
    return runs.resolve_aliases(runs.alias_table(_assignments(spark, folder), log), log).drop("updated_at")


def artifacts(spark, folder):
    """A file for each nation, of which every third was changed and every fifth never written."""
    nation = read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("run_id"))
    path = new_path(spark, "artifacts")
    content = F.when(F.col("k") % 3 == 0, F.concat("run_id", F.lit(" changed"))).otherwise(F.col("run_id"))
    kept = nation.where("k % 5 <> 0").select(content.alias("value"), F.col("run_id").alias("run"))
    kept.repartition("run").write.partitionBy("run").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    uri = F.regexp_extract("path", "(run=[^/]*/[^/]*)$", 1)
    files = files.select(uri.alias("uri"), F.regexp_extract(uri, "^run=([^/]*)/", 1).alias("run_id"))
    log = nation.join(files, "run_id", "left").select(
        "run_id",
        F.coalesce("uri", F.concat(F.lit("run="), "run_id", F.lit("/none"))).alias("artifact_uri"),
        F.sha2(F.concat("run_id", F.lit("\n")), 256).alias("artifact_hash"),
    )
    return runs.verify_artifacts(spark, log, path).select("run_id", "verification")


QUERIES = {
    "content_hash": content_hashes,
    "document_changes": changes,
    "document_change_stream": change_stream,
    "page_sections": page_sections,
    "document_chunks": document_chunks,
    "page_chunks": page_chunks,
    "replace_chunks": replaced_chunks,
    "replace_chunks_in_buckets": replaced_chunks_in_buckets,
    "source_overview": source_overview,
    "token_totals": token_totals,
    "spec_chunks": spec_chunks,
    "embed_documents": embedded,
    "cosine_top_k": nearest,
    "cosine_top_k_many": nearest_many,
    "cosine_top_k_blocks": nearest_blocks,
    "cosine_top_k_filtered": nearest_filtered,
    "cosine_scan": similarity_scan,
    "citations": citations,
    "sufficient_evidence": evidence,
    "run_page": run_page,
    "run_config_hash": run_config_hashes,
    "duplicate_runs": duplicate_runs,
    "duplicate_flags": duplicate_flags,
    "duplicates_denied": duplicates_denied,
    "transition_audit": transitions,
    "config_diff": config_diffs,
    "metric_diff": metric_diffs,
    "alias_table": alias_table,
    "alias_resolution": resolved_aliases,
    "artifact_verification": artifacts,
}

# -- SQL twins ---------------------------------------------------------------------------

_DOCS = "select doc_id, source as source_type, lang || '/' || doc_id as source_path, text as content, n_chars, 'src-' || doc_id as source_id from documents"
_STORED = """select source_id, sha256(case when source_path like 'fr/%' then content || ' ' else content end) as old_hash
from docs where n_chars > 500"""
_STATUS = """select d.doc_id, d.source_type, d.source_path, s.source_id, d.source_id as own_id,
       case when s.old_hash = sha256(d.content) then 'unchanged' when s.old_hash is not null then 'updated' else 'indexed' end as status
from docs d left join stored s on s.source_id = d.source_id"""
_PARTS = """select doc_id, source_id, source_type, chunk_index, content, length(content) - length(replace(content, ' ', '')) + 1 as token_count
from (select doc_id, source_id, source_type, unnest(string_split(content, chr(10))) as content,
             unnest(range(len(string_split(content, chr(10))))) as chunk_index from docs) t"""

_DUP = """select config_hash, store_id, product_id, data_window_start, data_window_end, count(*) as runs,
       arg_min(run_id, (created_at, run_id)) as first_run_id
from model_run where status <> 'archived' group by 1, 2, 3, 4, 5 having count(*) > 1"""
_MARKED = """select m.*, case when m.run_id <> d.first_run_id then d.first_run_id end as duplicate_of
from model_run m left join dup d using (config_hash, store_id, product_id, data_window_start, data_window_end)"""

_LABELLED = """select e.vec_id, e.embedding::double[] as v, 'type' || label as source_type, label % 3 as category from embeddings e"""
_QUERY = """select vec_id as query_id, embedding::double[] as q from embeddings
where vec_id in (select min(vec_id) from embeddings group by label)"""
_SCORED = """select query_id, vec_id, source_type, category, list_cosine_similarity(v, q) as s from labelled cross join wanted"""


def _top_sql(k, threshold, where="true", select=None):
    return with_views(
        "",
        select
        or f"select query_id, cast(rank as int) as rank, vec_id as chunk_id, {r('s', 'relevance_score')} from hits",
        labelled=_LABELLED,
        wanted=_QUERY,
        scored=_SCORED,
        hits=f"""select * from (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank
from scored where s >= {threshold} and {where}) t where rank <= {k}""",
    )


_SECTION_CTES = {
    "outline": """select page_id, replace(replace(replace(replace(replace(replace(html, '<title>', chr(10) || '# '), '</title>', chr(10)),
       '<h1>', chr(10) || '## '), '</h1>', chr(10)), '<li>', chr(10) || '### '), '<p>', chr(10) || chr(10)) as content from pages""",
    "lines": """select page_id, unnest(string_split(content, chr(10))) as line,
       unnest(range(len(string_split(content, chr(10))))) as n from outline""",
    "marked": r"""select *, regexp_matches(line, '^#{1,6}\s+.+$') as is_head,
       sum(cast(regexp_matches(line, '^#{1,6}\s+.+$') as int)) over (partition by page_id order by n) as sec from lines""",
    "secs": r"""select page_id, sec, string_agg(line || chr(10), '' order by n) as content,
       max(case when is_head then length(regexp_extract(line, '^(#{1,6})\s', 1)) end) as level,
       max(case when is_head then trim(regexp_extract(line, '^#{1,6}\s+(.+)$', 1)) end) as heading
from marked group by 1, 2""",
    "kept": r"""select * from secs where regexp_matches(content, '\S')""",
    # depth of a heading: its level, but at most one more than the depth before it
    "depths": """select *, case when heading is not null then
       sec + least(0, min(level - sec) over (partition by page_id order by sec)) end as depth from kept""",
    "held": "select *, "
    + ", ".join(
        f"last_value(case when depth = {d} then heading end ignore nulls) over "
        f"(partition by page_id order by sec rows between unbounded preceding and current row) as h{d}"
        for d in range(1, 7)
    )
    + " from depths",
}

_SIZE, _OVERLAP, _LEAST = 512, 50, 100


def _chunk_ctes(key: str) -> dict[str, str]:
    """Chunks of ``parts`` (key, sec, path, heading, content): one step of the recursion for each chunk."""
    end = f"""case when n <= s + room then n else coalesce(
        list_max(list_filter(sb, lambda x: x between s + {_LEAST} and s + room)),
        list_max(list_filter(pb, lambda x: x between s + {_LEAST} and s + room)),
        list_max(list_filter(tb, lambda x: x between s + {_LEAST} and s + room)), s + room) end"""
    return {
        "pieces": f"""select {key}, sec, path, heading, unnest(regexp_extract_all(content, '\\S+\\s*')) as p,
       unnest(range(len(regexp_extract_all(content, '\\S+\\s*')))) as j from parts""",
        "tokens": f"""select *, row_number() over (partition by {key} order by sec, j) - 1 as i,
       lag(p) over (partition by {key} order by sec, j) as before from pieces""",
        "listed": f"""select {key}, count(*) as n, list(p order by i) as ps, list(i order by i) filter (j = 0) as sb,
       list(path order by i) filter (j = 0) as paths, list(heading order by i) filter (j = 0) as heads,
       list(i order by i) filter (length(before) - length(replace(before, chr(10), '')) > 1) as pb,
       list(i order by i) filter (regexp_matches(before, '[.!?]\\s')) as tb from tokens group by 1""",
        "steps": f"""select {key}, 0 as k, cast(0 as bigint) as s, {end.replace("room", str(_SIZE)).replace(" s ", " 0 ")} as e
from (select *, cast(0 as bigint) as s from listed)
union all
select {key}, k + 1, e, {end} from (
  select l.*, r.k, r.s as old, r.e, r.e as s, {_SIZE - _OVERLAP} + greatest(0, {_OVERLAP} - r.e) as room
  from steps r join listed l using ({key}) where r.e < l.n)""",
    }


def _chunks_sql(key: str, **ctes: str) -> str:
    made = {**ctes, **_chunk_ctes(key)}
    at = "len(list_filter(sb, lambda x: x <= s))"
    return "with recursive " + ", ".join(f"{name} as ({sql})" for name, sql in made.items()) + f"""
select {key}, cast(k as int) as chunk_index,
       regexp_replace(array_to_string(ps[greatest(0, s - {_OVERLAP}) + 1 : e], ''), '\\s+$', '') as content,
       cast(e - greatest(0, s - {_OVERLAP}) as int) as token_count, heads[{at}] as heading, paths[{at}] as section_path
from steps join listed using ({key})"""


_SPEC_SQL = """
select p_partkey, 0 as chunk_index, 'api_info' as type, null as path, null as method, null as operation_id, null as summary, null as tags,
       '# ' || p_name || chr(10) || 'Version: 1.0' || chr(10) || chr(10) || '## Servers' || chr(10) || '- https://' || p_brand as content from part
union all
select p_partkey, 1, 'endpoint', '/parts/' || p_partkey, 'GET', 'read_' || p_partkey, p_type, 'parts,' || p_brand,
       '## GET /parts/' || p_partkey || chr(10) || '**' || p_type || '**' || chr(10) || chr(10) || 'Tags: parts, ' || p_brand || chr(10)
       || chr(10) || '### Parameters' || chr(10) || '- `id` (path) (required): key' || chr(10)
       || chr(10) || '### Responses' || chr(10) || '- **200**: found' || chr(10) || '- **404**: none' from part
union all
select p_partkey, 2, 'endpoint', '/parts/' || p_partkey, 'DELETE', 'delete_/parts/' || p_partkey, null, '',
       '## DELETE /parts/' || p_partkey || chr(10) || chr(10) || 'Removes it' from part
union all
select p_partkey, 3, 'endpoint', '/size', 'POST', 'post_/size', 'Size ' || p_size, '',
       '## POST /size' || chr(10) || '**Size ' || p_size || '**' from part"""

_CONFIG = """select o_orderkey as run_id, 'model' as key, cast(o_orderkey % 3 as varchar) as v from orders
union all select o_orderkey, 'window', cast(o_orderkey % 4 as varchar) from orders
union all select o_orderkey, 'seed', '42' from orders
union all select o_orderkey, 'season', '7' from orders where o_orderkey % 3 = 1"""
_METRIC = """select o_orderkey as run_id, 'mae' as key, o_totalprice / 1000 as v from orders
union all select o_orderkey, 'wape', cast(o_orderkey % 100 as double) from orders where o_orderkey % 2 = 0"""
_DIFF = """select p.a as run_a, p.b as run_b, k.key, x.v as a, y.v as b
from (select a.o_orderkey as a, b.o_orderkey as b from orders a join orders b on b.o_orderkey = a.o_orderkey + 1) p
join (select distinct key from vals) k on true
left join vals x on x.run_id = p.a and x.key = k.key left join vals y on y.run_id = p.b and y.key = k.key
where x.v is not null or y.v is not null"""
_ALIAS = """select 'alias-' || (o_custkey % 100) as alias_name, arg_max(m.run_id, o_orderkey) as run_id, max(o_orderkey) as updated_at
from orders join model_run m on m.run_id = md5(cast(o_orderkey as varchar)) where m.status = 'success' group by 1"""

ORACLES = {
    "artifact_verification": """select n_name as run_id, case when n_nationkey % 5 = 0 then 'missing'
       when n_nationkey % 3 = 0 then 'mismatch' else 'ok' end as verification from nation""",
    "content_hash": "select doc_id, sha256(text) as content_hash from documents",
    "document_changes": with_views(
        "", "select doc_id, source_type, source_path, source_id, status from status", docs=_DOCS, stored=_STORED, status=_STATUS
    ),
    "document_change_stream": with_views(
        "",
        """select cast(0 as bigint) as batch_id, source_type, source_path, 'indexed' as status from docs where n_chars > 500
union all select 1, source_type, source_path, status from status
union all select 2, source_type, source_path, case when source_path like 'de/%' then 'updated' else 'unchanged' end from docs""",
        docs=_DOCS,
        stored=_STORED,
        status=_STATUS,
    ),
    "page_sections": with_views(
        "",
        """select page_id, cast(row_number() over (partition by page_id order by sec) - 1 as int) as section_index,
       concat_ws(' > ', h1, case when depth >= 2 then h2 end, case when depth >= 3 then h3 end,
                 case when depth >= 4 then h4 end, case when depth >= 5 then h5 end, case when depth >= 6 then h6 end) as path,
       heading, cast(coalesce(level, 0) as int) as level, content from held""",
        **_SECTION_CTES,
    ),
    "document_chunks": _chunks_sql(
        "doc_id", parts="select doc_id, 0 as sec, '' as path, cast(null as varchar) as heading, text as content from documents"
    ),
    "page_chunks": _chunks_sql(
        "page_id",
        **_SECTION_CTES,
        parts="""select page_id, sec, concat_ws(' > ', h1, case when depth >= 2 then h2 end, case when depth >= 3 then h3 end,
                 case when depth >= 4 then h4 end, case when depth >= 5 then h5 end, case when depth >= 6 then h6 end) as path,
       case depth when 1 then h1 when 2 then h2 when 3 then h3 when 4 then h4 when 5 then h5 when 6 then h6 end as heading, content from held""",
    ),
    "replace_chunks": with_views(
        "",
        """select source_id, count(*) as chunks, count(*) filter (content = upper(content)) as upper_chunks from (
select source_id, content from parts where source_id in (select source_id from status where status = 'unchanged')
union all
select source_id, upper(content) from parts where source_id in (select own_id from status where status <> 'unchanged')) t group by 1""",
        docs=_DOCS,
        stored=_STORED,
        status=_STATUS,
        parts=_PARTS,
    ),
    "source_overview": with_views(
        "",
        """select d.source_id, d.source_type, d.source_path, count(p.source_id) as chunk_count,
       cast(coalesce(sum(p.token_count), 0) as bigint) as token_total
from (select source_id, source_type, source_path from docs
      union all select distinct 'new-' || lang, lang, lang from documents) d
left join parts p on p.source_id = d.source_id group by 1, 2, 3""",
        docs=_DOCS,
        parts=_PARTS,
    ),
    "token_totals": with_views(
        "",
        "select source_type, cast(sum(token_count) as bigint) as tokens_processed from parts group by 1",
        docs=_DOCS,
        parts=_PARTS,
    ),
    "spec_chunks": _SPEC_SQL.strip(),
    "embed_documents": """select doc_id, length(text) as chars, length(text) - length(replace(text, ' ', '')) + 1 as words,
       length(text) - length(replace(text, chr(10), '')) + 1 as lines from documents""",
    "cosine_top_k": _top_sql(10, 0.1, "query_id = 0"),
    "cosine_top_k_many": _top_sql(7, 0.2),
    "cosine_top_k_blocks": _top_sql(7, 0.2),
    "cosine_top_k_filtered": _top_sql(5, 0.0, "source_type in ('type1', 'type3', 'type4', 'type7') and category = 1"),
    "cosine_scan": f"""select vec_id, {r("list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0))", 'similarity')}
from embeddings""",
    "citations": _top_sql(
        5,
        0.2,
        select="""select query_id, cast(rank as int) as rank, vec_id as chunk_id, source_type, source as source_path,
       printf('%.2f', floor(round(s, 4) * 100 + 0.5) / 100) as relevance,
       case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as snippet
from hits left join documents on doc_id = vec_id""",
    ),
    "sufficient_evidence": _top_sql(
        3,
        0.25,
        select=f"""select query_id, count(s) as results, {r('avg(round(s, 4))', 'mean_relevance', 3)},
       count(s) >= 2 and coalesce(avg(round(s, 4)) >= 0.5, false) as sufficient
from wanted left join hits using (query_id) group by query_id""",
    ),
    "run_page": with_views(
        "model_run",
        f"""select run_id, status, model_type, config_hash, store_id, product_id, data_window_start, data_window_end, {r('mae', 'mae')},
       (select count(*) from model_run where model_type = 'naive' and status = 'success' and store_id = 4) as total
from (select * from model_run where model_type = 'naive' and status = 'success' and store_id = 4
      order by created_at desc, run_id limit 50 offset 100) t""",
    ),
    "run_config_hash": """select o_orderkey, substring(sha256('{"alpha": null, "model": "m' || (o_orderkey % 3) || '", "window": ' || (o_orderkey % 4) || '}'), 1, 16) as config_hash
from orders""",
    "duplicate_runs": with_views("model_run", "select * from dup", dup=_DUP),
    "duplicate_flags": with_views("model_run", "select run_id, duplicate_of from marked", dup=_DUP, marked=_MARKED),
    "duplicates_denied": with_views(
        "model_run",
        "select status, model_type, count(*) as runs from marked where duplicate_of is null group by 1, 2",
        dup=_DUP,
        marked=_MARKED,
    ),
    "transition_audit": """select run_id, "at", from_status, status,
       coalesce((from_status is null and status = 'pending')
         or (from_status = 'pending' and status in ('running', 'archived'))
         or (from_status = 'running' and status in ('success', 'failed', 'archived'))
         or (from_status in ('success', 'failed') and status = 'archived'), false) as allowed
from (select *, lag(status) over (partition by run_id order by "at") as from_status from (
  select o_custkey as run_id, o_orderdate + to_microseconds(o_orderkey) as "at",
         case o_orderkey % 5 when 0 then 'pending' when 1 then 'running' when 2 then 'success' when 3 then 'failed' else 'archived' end as status
  from orders) t) u""",
    "config_diff": with_views("", "select * from diff where a is distinct from b", vals=_CONFIG, diff=_DIFF),
    "metric_diff": with_views(
        "", f"select run_a, run_b, key, {r('a', 'a')}, {r('b', 'b')}, {r('b - a', 'diff')} from diff", vals=_METRIC, diff=_DIFF
    ),
    "alias_table": with_views("model_run", _ALIAS),
    "alias_resolution": with_views(
        "model_run",
        "select a.alias_name, a.run_id, m.status as run_status, m.model_type from al a join model_run m on m.run_id = a.run_id",
        al=_ALIAS,
    ),
}
ORACLES["replace_chunks_in_buckets"] = ORACLES["replace_chunks"]

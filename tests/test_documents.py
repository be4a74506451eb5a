"""Documents, retrieval and the run log on small frames."""

import datetime as dt
import hashlib
import json
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfline.functions.chunking import ChunkRules, Words, chunks, outline
from shelfline.operators import documents as docs
from shelfline.operators import retrieval, runs

MARKDOWN = """Intro line

# Main Title
text
## Section One
one
### Subsection 1.1
deep
## Section Two
two
#### Skipped level
four
### Back to three
three
#no heading
####### seven marks
"""


def sections_of(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, content string")
    return [(r.path, r.heading, r.level, r.content) for r in docs.split_sections(df).orderBy("section_index").collect()]


def test_heading_paths(spark):
    got = sections_of(spark, MARKDOWN)
    assert [(p, h, lv) for p, h, lv, _ in got] == [
        ([], None, 0),
        (["Main Title"], "Main Title", 1),
        (["Main Title", "Section One"], "Section One", 2),
        (["Main Title", "Section One", "Subsection 1.1"], "Subsection 1.1", 3),
        (["Main Title", "Section Two"], "Section Two", 2),
        (["Main Title", "Section Two", "Skipped level"], "Skipped level", 4),
        # the skipped level left no hole, so this one keeps the two entries before it
        (["Main Title", "Section Two", "Back to three"], "Back to three", 3),
    ]
    assert "".join(c for *_, c in got) == MARKDOWN + "\n"
    assert got[-1][3].count("seven marks") == 1


@pytest.mark.parametrize("text", ["", "  \n \n", None])
def test_blank_documents_have_no_sections(spark, text):
    assert sections_of(spark, text) == []


def test_odd_headings(spark):
    got = sections_of(spark, "#\tTab\r\nbody\n#  \nx\n# Last")
    # a heading of blanks opens a section but names nothing
    assert [(p, h) for p, h, *_ in got] == [(["Tab"], "Tab"), (["Tab"], None), (["Last"], "Last")]


RULES = ChunkRules(size=10, overlap=2, least=3)


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def cut(text, rules=RULES):
    return [(list(path), part) for path, part, _ in chunks(text, rules, Words())]


def test_small_sections_share_a_chunk():
    text = f"# A\n{words(3)}\n## B\n{words(2)}\n"
    assert cut(text) == [(["A"], text.strip())]


def test_cuts_before_sections_and_repeats_the_overlap():
    text = f"# A\n{words(4)}\n# B\n{words(6, 4)}"
    assert cut(text) == [(["A"], f"# A\n{words(4)}"), (["B"], f"w2 w3\n# B\n{words(6, 4)}")]


def test_paragraphs_then_sentences_then_full():
    none = ChunkRules(size=10, overlap=0, least=3)
    paragraphs = f"{words(4)}\n\n{words(5, 4)}\n\n{words(4, 9)}"
    assert [t for _, t in cut(paragraphs, none)] == [f"{words(4)}\n\n{words(5, 4)}", words(4, 9)]
    sentences = "One two three four five six. Seven eight nine ten eleven! Twelve?"
    assert [t for _, t in cut(sentences, none)] == ["One two three four five six.", "Seven eight nine ten eleven! Twelve?"]
    assert [t for _, t in cut(words(25), none)] == [words(10), words(10, 10), words(5, 20)]


@pytest.mark.parametrize("overlap", [0, 4])
def test_no_token_is_lost(overlap):
    rng = np.random.default_rng(overlap)
    rules = ChunkRules(size=20, overlap=overlap, least=5)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "end. ", "x\n", "\n\n", "# Head\n", "### Sub\n", "  "], rng.integers(0, 200)))
        made = list(chunks(text, rules, Words()))
        new = [t for i, (_, part, _) in enumerate(made) for t in part.split()[(overlap if i else 0):]]
        assert new == text.split() and all(len(part.split()) == n <= 20 and part in text for _, part, n in made)


def test_long_sentences_and_short_rests_stay():
    assert [t for _, t in cut(words(9000), ChunkRules(overlap=0))][-1].endswith("w8999")
    text = f"# A\n{words(540)}\n# B\n{words(30)}"
    assert sum(n for *_, n in chunks(text, ChunkRules(overlap=0), Words())) == 574


def test_rules_are_checked():
    for bad in (dict(size=10, overlap=10), dict(size=10, overlap=2, least=9), dict(overlap=-1)):
        with pytest.raises(ValueError):
            ChunkRules(**bad)


def test_pack_chunks_job(spark):
    df = spark.createDataFrame([(1, "# T\n" + words(30)), (2, ""), (3, None), (4, "plain text")], "doc int, content string")
    out = {(r.doc, r.chunk_index): r for r in docs.pack_chunks(df, "doc", rules=ChunkRules(size=20, overlap=2, least=3)).collect()}
    assert set(out) == {(1, 0), (1, 1), (4, 0)} and out[1, 0].token_count == 20 and out[1, 1].heading == "T"
    assert out[4, 0].section_path == [] and out[4, 0].heading is None
    whole = docs.pack_chunks(df, "doc").collect()
    assert {r.doc for r in whole} == {1, 4}


def test_sections_are_linear():
    def seconds(n):
        text = "".join(f"{'#' * (i % 6 + 1)} h{i}\ntext of it\n" for i in range(n))
        tries = []
        for _ in range(3):  # the least of them: other processes may be busy
            began = time.process_time()
            assert len(outline(text)) == n
            tries.append(time.process_time() - began)
        return min(tries)

    seconds(4000)
    assert seconds(16_000) < 12 * seconds(4000)


def test_change_detection_and_replacement(spark, rows):
    stored = spark.createDataFrame(
        [("md", "a", "s1", hashlib.sha256(b"A").hexdigest()), ("md", "b", "s2", "old")], "source_type string, source_path string, source_id string, content_hash string")
    fresh = spark.createDataFrame([("md", "a", "A"), ("md", "b", "B"), ("md", "c", "C"), ("api", "a", "A")], "source_type string, source_path string, content string")
    assert rows(docs.detect_changes(fresh, stored), "source_type", "source_path", "status") == [
        ("api", "a", "indexed"), ("md", "a", "unchanged"), ("md", "b", "updated"), ("md", "c", "indexed")]
    old = spark.createDataFrame([("s1", 0, "x"), ("s2", 0, "y"), ("s2", 1, "z")], "source_id string, chunk_index int, content string")
    new = spark.createDataFrame([("s2", 0, "n")], "source_id string, chunk_index int, content string")
    assert rows(docs.replace_chunks(old, new, new.select("source_id"))) == [("s1", 0, "x"), ("s2", 0, "n")]
    sources = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source_id string")
    counted = docs.source_overview(sources, old.withColumn("token_count", F.lit(5)))
    assert rows(counted) == [("s1", 1, 5), ("s2", 2, 10), ("s3", 0, 0)]


SPEC = {
    "info": {"title": "Shop", "version": "2", "description": "About"},
    "servers": [{"url": "http://x", "description": "main"}, {"url": "http://y"}],
    "paths": {
        "/a": {"get": {"operationId": "getA", "summary": "Read", "tags": ["t1", "t2"], "responses": {"200": {"description": "ok"}}},
               "x-note": {"a": 1}, "parameters": [{"name": "q"}], "summary": "text"},
        "/b/{id}": {"post": {"description": "Make", "parameters": [{"name": "id", "in": "path", "required": True, "description": "d"}, {"name": "n", "in": "query"}],
                             "requestBody": {"content": {"application/json": {"schema": {"type": "object"}}}}}},
    },
}


def test_spec_chunks(spark):
    df = spark.createDataFrame([(1, json.dumps(SPEC)), (2, json.dumps({"paths": {"/z": {"get": {}}}})), (3, "no json")], "id int, content string")
    got = {(r.id, r.chunk_index): r for r in docs.spec_chunks(df, "id").collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)} and (got[3, 0].type, got[3, 0].content) == ("text", "no json")
    assert got[1, 0].content == "# Shop\nVersion: 2\n\nAbout\n\n## Servers\n- http://x (main)\n- http://y"
    assert got[1, 1].content == "## GET /a\n**Read**\n\nTags: t1, t2\n\n### Responses\n- **200**: ok"
    assert got[1, 2].content == "## POST /b/{id}\n\nMake\n\n### Parameters\n- `id` (path) (required): d\n- `n` (query): \n\n### Request Body\nContent-Type: application/json\n```json\n{\"type\":\"object\"}\n```"
    assert got[1, 2].operation_id == "post_/b/{id}" and got[1, 1].tags == ["t1", "t2"] and got[2, 0].tags == []


class Letters(docs.EmbeddingProvider):
    dimension = 2
    max_tokens = 3
    batch_size = 2

    def embed(self, texts):
        assert len(texts) <= 2
        return [[float(len(t)), float(len(t.split()))] for t in texts]


def test_embedding_hook_keeps_order_and_pools_long_texts(spark):
    df = spark.createDataFrame([(i, words(i)) for i in range(1, 8)], "n int, content string").coalesce(1)
    got = {r.n: r.embedding for r in docs.embed(df, Letters()).collect()}
    # parts of 3, 3 and 1 words, averaged by their words
    assert [got[i][1] for i in (1, 3, 6)] == [1, 3, 3] and got[4][1] == 2.5 and got[7][1] == pytest.approx(19 / 7)


# -- retrieval ---------------------------------------------------------------------------------


@pytest.mark.parametrize("few,block,part_bytes", [(256, 1024, 1 << 20), (0, 1024, 1 << 20), (0, 3, 640)])
def test_top_k_equals_brute_force(spark, monkeypatch, few, block, part_bytes):
    monkeypatch.setattr(retrieval, "FEW", few)
    monkeypatch.setattr(retrieval, "HELD", 10)
    monkeypatch.setattr(retrieval, "PART_BYTES", part_bytes)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[10] = x[20]  # an exact tie
    x[30] = 0
    q = rng.normal(size=(7, 8)).astype(np.float32)
    q[0] = x[10]
    chunks = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "chunk_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", [float(v) for v in r]) for i, r in enumerate(q)], "query_id string, embedding array<float>")
    got = {}
    for r in retrieval.top_k(chunks, queries, 4, 0.3, block=block).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.relevance_score)
    x64, q64 = x.astype(float), q.astype(float)
    for i in range(7):
        norms = np.linalg.norm(x64, axis=1) * np.linalg.norm(q64[i])
        s = np.divide(x64 @ q64[i], norms, out=np.full(300, -9.0), where=norms > 0)
        best = sorted((-round(v, 9), j) for j, v in enumerate(s) if v >= 0.3)[:4]
        want = {n + 1: j for n, (_, j) in enumerate(best)}
        assert {n: j for n, (j, _) in got.get(f"q{i}", {}).items()} == want


def clusters(spark, n=3000, size=16):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, size))
    x = centres[rng.integers(0, 40, n)] + 0.2 * rng.normal(size=(n, size))
    x[: n // 3] = x[0]  # a third of the chunks are copies
    chunks = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id int, embedding array<double>").repartition(4)
    return x, chunks


@pytest.mark.parametrize("partitions", ["4", "50"])
def test_parts_are_bounded_and_few_of_them_are_asked(spark, monkeypatch, partitions):
    """As many query rows as parts may hold hits, whatever the shuffle partitions; the same rows as a scan."""
    x, chunks = clusters(spark)
    asked = spark.createDataFrame([(f"q{i}", [float(v) for v in x[i]]) for i in range(0, 3000, 10)], "query_id string, embedding array<double>")
    rows = sorted(tuple(r) for r in retrieval.top_k(chunks, asked, 6, 0.5).collect())
    met, chosen = [], retrieval._choose

    def choose(pivots, sample, parts, *rest):
        met.append((pivots, sample, parts))
        return chosen(pivots, sample, parts, *rest)

    monkeypatch.setattr(retrieval, "_choose", choose)
    monkeypatch.setattr(retrieval, "FEW", 10)
    monkeypatch.setattr(retrieval, "PART_BYTES", 100 * 16 * 8)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        again = sorted(tuple(r) for r in retrieval.top_k(chunks, asked, 6, 0.5).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r[:3] for r in again] == [r[:3] for r in rows] and np.allclose([r[3] for r in again], [r[3] for r in rows], atol=1.01e-4)
    pivots, sample, parts = met[0]
    number = sum(pieces for _, pieces in {(first, pieces) for _, _, first, pieces, _, _ in parts})
    assert number >= 30 and number == max(first + pieces for _, _, first, pieces, _, _ in parts)
    wanted = retrieval._choose(pivots, sample, parts, 6, 0.5, {"q": pa.string(), "c": pa.int32()})
    batch = pa.RecordBatch.from_pydict({"q": [f"q{i}" for i in range(0, 3000, 10)], "v": [x[i].tolist() for i in range(0, 3000, 10)]})
    assert sum(b.num_rows for b in wanted(iter([batch]))) < number * 300 / 2


def test_no_queries_no_hits(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([], "query_id string, embedding array<float>")
    assert retrieval.top_k(chunks, queries).count() == 0


def test_citations_and_evidence(spark):
    hits = spark.createDataFrame([("q1", 1, 5, 0.9), ("q1", 2, 6, 0.6), ("q2", 1, 6, 0.4)], "query_id string, rank int, chunk_id int, relevance_score double")
    chunks = spark.createDataFrame([(5, "md", "a", "x" * 201), (6, "md", "b", "y" * 200)], "chunk_id int, source_type string, source_path string, content string")
    got = {(r.query_id, r["rank"]): r for r in retrieval.citations(hits, chunks).collect()}
    assert got["q1", 1].snippet == "x" * 200 + "..." and got["q1", 2].snippet == "y" * 200 and got["q1", 1].relevance == "0.90"
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")
    ok = {r.query_id: r.sufficient for r in retrieval.sufficient_evidence(hits, queries).collect()}
    assert ok == {"q1": True, "q2": False, "q3": False}
    none_needed = retrieval.sufficient_evidence(hits, queries, min_results=0)
    assert {r.query_id: r.sufficient for r in none_needed.collect()}["q3"]


# -- run log ------------------------------------------------------------------------------------


T0 = dt.datetime(2024, 1, 1)


def at(i):
    return T0 + dt.timedelta(minutes=i)


def test_config_hash_column_equals_the_plain_hash(spark):
    config = {"window": 7, "model": "naive", "alpha": None, "x": 1.5}
    df = spark.createDataFrame([({k: json.dumps(v) for k, v in config.items()},)], "config map<string,string>")
    assert df.select(runs.config_hash_column(F.col("config"))).first()[0] == runs.config_hash(config)
    assert runs.config_hash({"b": 1, "a": 2}) == runs.config_hash({"a": 2, "b": 1})


@pytest.mark.parametrize("block_rows", [None, 2])
def test_transitions(spark, block_rows):
    events = [("r1", s, at(i)) for i, s in enumerate(["pending", "running", "success", "archived"])]
    events += [("r2", s, at(i)) for i, s in enumerate(["pending", "success", "running", "failed", "running"])]
    events += [("r3", "running", at(0)), ("r4", "pending", at(0)), ("r4", "archived", at(1)), ("r4", "pending", at(2))]
    out = runs.transition_audit(spark.createDataFrame(events, "run_id string, status string, at timestamp"), block_rows)
    bad = {(r.run_id, r.from_status, r.status) for r in out.where("not allowed").collect()}
    assert bad == {("r2", "pending", "success"), ("r2", "success", "running"), ("r2", "failed", "running"),
                   ("r3", None, "running"), ("r4", "archived", "pending")}
    assert out.count() == len(events)


LOG = "run_id string, status string, model_type string, config_hash string, store_id int, product_id int, data_window_start date, data_window_end date, created_at timestamp"


def log_row(run, status, i, key="h", model="naive"):
    return (run, status, model, key, 1, 1, dt.date(2024, 1, 1), dt.date(2024, 2, 1), at(i))


def test_duplicate_policies(spark, rows):
    log = spark.createDataFrame([log_row("a", "success", 2), log_row("b", "pending", 1), log_row("c", "archived", 0), log_row("d", "success", 5, "other")], LOG)
    assert rows(runs.duplicate_groups(log), "runs", "first_run_id") == [(2, "b")]
    assert rows(runs.apply_duplicate_policy(log, "detect"), "run_id", "duplicate_of") == [("a", "b"), ("b", None), ("c", None), ("d", None)]
    assert rows(runs.apply_duplicate_policy(log, "deny"), "run_id") == [("b",), ("c",), ("d",)]
    assert runs.apply_duplicate_policy(log, "allow").count() == 4
    with pytest.raises(ValueError):
        runs.apply_duplicate_policy(log, "maybe")


def test_list_runs_newest_first(spark):
    log = spark.createDataFrame([log_row(f"r{i}", "success" if i % 2 else "failed", i) for i in range(10)], LOG)
    page = runs.list_runs(log, page=1, size=2, status="success").collect()
    assert [r.run_id for r in page] == ["r9", "r7"] and page[0].total == 5


def test_run_differences(spark, rows):
    log = spark.createDataFrame(
        [("a", {"m": "x", "w": "7"}, {"mae": 1.0, "only": 2.0}), ("b", {"m": "y", "w": "7", "s": "3"}, {"mae": 4.0})],
        "run_id string, config map<string,string>, metrics map<string,double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "missing")], "run_a string, run_b string")
    assert rows(runs.config_diff(pairs, log), "key", "a", "b") == [("m", "x", "y"), ("s", None, "3")]
    assert rows(runs.metric_diff(pairs, log), "key", "a", "b", "diff") == [("mae", 1.0, 4.0, 3.0), ("only", 2.0, None, None)]


def test_aliases_point_to_successful_runs(spark, rows):
    log = spark.createDataFrame([log_row("a", "success", 0), log_row("b", "success", 1), log_row("c", "failed", 2)], LOG)
    given = spark.createDataFrame([("prod", "a", at(0)), ("prod", "b", at(1)), ("prod", "c", at(2)), ("none", "c", at(0))], "alias_name string, run_id string, at timestamp")
    table = runs.alias_table(given, log)
    assert rows(runs.resolve_aliases(table, log), "alias_name", "run_id", "run_status") == [("prod", "b", "success")]
    assert runs.resolve_aliases(table, log, "none").count() == 0


def test_config_hash_column_keeps_nulls(spark):
    df = spark.createDataFrame([({"a": "1", "b": None},), ({"a": "1"},)], "config map<string,string>")
    got = [r[0] for r in df.select(runs.config_hash_column(F.col("config"))).collect()]
    assert got == [runs.config_hash({"a": 1, "b": None}), runs.config_hash({"a": 1})] and got[0] != got[1]


def test_artifact_verification(spark, tmp_path, rows):
    tmp_path = tmp_path / "m %41 x"  # a folder of the same name below itself, and characters of URLs
    (tmp_path / "m").mkdir(parents=True)
    (tmp_path / "m" / "a.bin").write_bytes(b"model a")
    (tmp_path / "m" / "b.bin").write_bytes(b"changed")
    good = hashlib.sha256(b"model a").hexdigest()
    log = spark.createDataFrame([("a", "m/a.bin", good), ("b", "m/b.bin", good), ("c", "m/c.bin", good)], "run_id string, artifact_uri string, artifact_hash string")
    assert rows(runs.verify_artifacts(spark, log, str(tmp_path)), "run_id", "verification") == [("a", "ok"), ("b", "mismatch"), ("c", "missing")]


def test_files_are_hashed_in_pieces(spark, tmp_path):
    """A file above the size of a piece, an empty one, one whose name says it is compressed; no piece is larger."""
    content = {"big.bin": bytes(range(256)) * 50_000, "none.bin": b"", "text.gz": b"not compressed"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    listed = spark.createDataFrame([(f"{tmp_path}/{name}",) for name in (*content, "missing")] + [(None,)], "path string")

    class Noted:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.stream.close()

        def read(self, n):
            assert n == 1 << 16
            return self.stream.read(n)

    got = {r.path and r.path.rsplit("/", 1)[1]: r.file_hash for r in runs.file_hashes(listed, lambda path: Noted(runs.open_artifact(path)), 1 << 16).collect()}
    assert got == {name: hashlib.sha256(data).hexdigest() for name, data in content.items()} | {"missing": None, None: None}


def test_artifacts_outside_the_folder_are_missing(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.bin").write_bytes(b"a")
    good = hashlib.sha256(b"a").hexdigest()
    log = spark.createDataFrame([("a", "../a.bin", good), ("b", f"{tmp_path}/a.bin", good), ("c", "x/../../a.bin", good), ("d", None, good)], "run_id string, artifact_uri string, artifact_hash string")
    assert rows(runs.verify_artifacts(spark, log, f"file://{tmp_path}/in/"), "verification") == [("missing",)] * 4


def test_texts_are_taken_by_bytes(spark):
    """Texts of uneven length, some at a time, in the same order."""
    texts = ["x" * n for n in (5, 1, 30, 2, 2, 2, 50)]
    assert list(docs._runs(texts, 10)) == [texts[:2], texts[2:3], texts[3:6], texts[6:]] and list(docs._runs([], 10)) == []
    batch = pa.RecordBatch.from_pydict({"t": texts})
    pieces = list(docs._small(batch, 40))
    assert [t for p in pieces for t in p.column(0).to_pylist()] == texts and len(pieces) > 2


def test_a_worker_cuts_few_texts_at_once(spark, rows, monkeypatch):
    """However many texts Spark sends in a batch, the tokens and slices of about a megabyte are held."""
    texts = [f"# T{i}\n" + f"word{i} " * 3000 for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    pieces = list(docs._small(batch))
    assert [t for p in pieces for t in p.column(0).to_pylist()] == texts and max(p.nbytes for p in pieces) <= 1 << 20
    table = spark.createDataFrame([(i, t if i % 7 else None) for i, t in enumerate(texts)], "id int, content string").coalesce(1)
    sections = docs.split_sections(table)
    assert rows(sections, "id", "content") == sorted(((i, t + "\n") for i, t in enumerate(texts) if i % 7), key=lambda r: (False, str(r[0])))
    found = docs.pack_chunks(table, "id").groupBy("id").count()
    assert {(r["id"], r["count"]) for r in found.collect()} == {(i, 7) for i in range(400) if i % 7}

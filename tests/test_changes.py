"""Change detection on a stream of documents."""

import hashlib
import json

import pytest

from shelfline.streaming import changes

ROW = "source_type string, source_path string, content string, row_index long"


@pytest.fixture
def incoming(spark, tmp_path):
    """Write documents as one file, run the stream over what is new, and give the judged rows of the last batch."""
    folder, state, log = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "log")
    folder.mkdir()
    changes.create_state(spark, state, buckets=16)
    count = 0

    def run(*documents):
        nonlocal count
        lines = [json.dumps({"source_type": "md", "source_path": p, "content": c, "row_index": i}) for i, (p, c) in enumerate(documents)]
        (folder / f"{count}.json").write_text("\n".join(lines))
        count += 1
        stream = spark.readStream.schema(ROW).json(str(folder))
        changes.start_change_detection(stream, state, log, str(tmp_path / "marks"), buckets=16).awaitTermination()
        judged = changes.judged_documents(spark, log, state).where(f"batch_id = {count - 1}").collect()
        return {r.source_path: r.status for r in judged}

    run.state, run.log = state, log
    return run


def hashes(spark, state):
    return {r.source_path: (r.source_id, r.content_hash) for r in changes.read_state(spark, state, 16).collect()}


def test_unchanged_changed_and_new(spark, incoming):
    assert incoming(("a", "one"), ("b", "two"), ("c", "")) == {"a": "indexed", "b": "indexed", "c": "indexed"}
    first = hashes(spark, incoming.state)
    assert incoming(("a", "one"), ("b", "two!"), ("d", "new")) == {"a": "unchanged", "b": "updated", "d": "indexed"}
    second = hashes(spark, incoming.state)
    assert second["b"][0] == first["b"][0] and second["b"][1] != first["b"][1] and second["a"] == first["a"] and set(second) == set("abcd")
    # several texts of a source in a batch: the last counts
    assert incoming(("b", "two!"), ("d", "x"), ("d", "new"), ("e", "x"), ("e", "y")) == {"b": "unchanged", "d": "unchanged", "e": "indexed"}
    assert incoming(("e", "y")) == {"e": "unchanged"}


def test_a_repeated_batch_changes_nothing(spark, incoming, rows):
    incoming(("a", "one"), ("b", "two"))
    incoming(("a", "one!"))
    before, judged = hashes(spark, incoming.state), rows(changes.judged_documents(spark, incoming.log, incoming.state))
    stream = changes.judged_documents(spark, incoming.log, incoming.state).first().stream
    batch = spark.createDataFrame([("md", "a", "one!", 0)], ROW)
    assert not changes.apply_batch(batch, 1, stream, incoming.state, incoming.log, "row_index", 16)
    assert hashes(spark, incoming.state) == before and rows(changes.judged_documents(spark, incoming.log, incoming.state)) == judged


def test_a_batch_that_died_before_its_version_is_judged_again(spark, incoming, monkeypatch):
    incoming(("a", "one"))
    stream = changes.judged_documents(spark, incoming.log, incoming.state).first().stream
    batch = spark.createDataFrame([("md", "a", "two", 0), ("md", "b", "x", 1)], ROW)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(changes.versions, "replace", die)
        with pytest.raises(RuntimeError):
            changes.apply_batch(batch, 1, stream, incoming.state, incoming.log, "row_index", 16)
    assert changes.judged_documents(spark, incoming.log, incoming.state).where("batch_id = 1").count() == 0
    assert changes.apply_batch(batch, 1, stream, incoming.state, incoming.log, "row_index", 16)
    assert {r.source_path: r.status for r in changes.judged_documents(spark, incoming.log, incoming.state).where("batch_id = 1").collect()} == {"a": "updated", "b": "indexed"}


def test_a_batch_rewrites_the_buckets_of_its_keys(spark, incoming):
    incoming(*[(f"p{i}", "x") for i in range(200)])
    before = changes.versions.current(spark, incoming.state).folders
    incoming(("p7", "y"))
    after = changes.versions.current(spark, incoming.state).folders
    assert sum(before[b] != after[b] for b in before) == 1 and len(hashes(spark, incoming.state)) == 200


def test_texts_are_written_once_and_not_shuffled(spark, incoming, monkeypatch):
    judge, seen = changes.detect_changed_hashes, []

    def judged(fresh, known):
        seen.append(fresh)
        return judge(fresh, known)

    monkeypatch.setattr(changes, "detect_changed_hashes", judged)
    incoming(("a", "one"), ("b", "two"), ("a", "three"), ("c", None))
    incoming(("a", "one"), ("b", "two"))
    assert seen and all("content" not in s.columns for s in seen)
    assert all("content:string" not in s._jdf.queryExecution().executedPlan().toString() for s in seen)  # nor do scans read them
    columns = ["source_path", "status", "content", "content_hash"]
    found = {(r.batch_id, r.source_path): r for r in changes.judged_documents(spark, incoming.log, incoming.state, columns).collect()}
    assert {k: (r.status, r.content) for k, r in found.items()} == {
        (0, "a"): ("indexed", "three"), (0, "b"): ("indexed", "two"), (0, "c"): ("indexed", None), (1, "a"): ("updated", "one"), (1, "b"): ("unchanged", "two")}
    assert all(r.content_hash == (r.content and hashlib.sha256(r.content.encode()).hexdigest()) for r in found.values())


def test_texts_without_order_or_of_one_place_keep_their_hash(spark, incoming):
    incoming(("z", "x"))
    stream = changes.judged_documents(spark, incoming.log, incoming.state).first().stream
    batch = spark.createDataFrame([("md", "a", "no order", None), ("md", "b", "one", 5), ("md", "b", "other", 5), ("md", "b", "none", None)], ROW)
    assert changes.apply_batch(batch, 1, stream, incoming.state, incoming.log, "row_index", 16)
    found = changes.judged_documents(spark, incoming.log, incoming.state, ["source_path", "content", "content_hash"]).where("batch_id = 1").collect()
    texts = {r.source_path: r.content for r in found}
    assert len(found) == 2 and texts["a"] == "no order" and texts["b"] in ("one", "other")
    assert all(r.content_hash == hashlib.sha256(r.content.encode()).hexdigest() for r in found)

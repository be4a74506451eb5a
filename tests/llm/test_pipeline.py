"""The pipeline's stages, one after the other, against what each promises."""

import os
from collections import Counter

import corpus_pipeline
from shelfline.llm import pii
from shelfline.llm.common import discard, noted, stored


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.dtypes, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        seen.append(docs)
        if name != "packing":
            assert docs.dtypes == columns
    ids = [Counter(r.doc_id for r in df.select("doc_id").collect()) for df in seen]
    assert all(set(after) <= set(before) for before, after in zip(ids, ids[1:]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [d for d in ids[0] if d in labels]
    assert sum((d in ids[1]) == (labels[d] == 1) for d in judged) / len(judged) >= 0.95
    texts = [r.text for r in seen[1].collect()]
    assert len(ids[2]) <= len(set(texts)) and max(ids[2].values()) == 1
    assert ids[3] == ids[2] and not any(any(pii.find(r.text)[0].values()) for r in seen[3].collect())
    assert max(ids[4].values()) <= 3
    first = Counter(r.doc_id for r in seen[5].where("piece = 0").collect())
    assert first == ids[4]


def test_stored_tables_are_noted_and_discarded(spark):
    with noted() as outer:
        first = stored(spark.range(3), "test-a")
        with noted() as inner:
            second = stored(spark.range(4), "test-b")
        third = stored(spark.range(5), "test-c")
    stored(spark.range(1), "test-d")
    assert len(outer) == 3 and inner == outer[1:2]
    discard(spark, inner)
    assert first.count() == 3 and third.count() == 5 and not os.path.exists(inner[0])
    assert os.path.exists(outer[0]) and second.schema == first.schema


def test_run_is_the_stages(spark, folder):
    with noted() as paths:
        out = corpus_pipeline.run(spark, folder)
    # what is left feeds the last stage, or was made by it
    left = [p for p in paths if os.path.exists(p)]
    assert sum("pipeline-" in p for p in left) == 1 and any("pipeline-mixing" in p for p in left) and len(paths) > 2 * len(left)
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count()

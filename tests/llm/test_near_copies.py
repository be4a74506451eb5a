"""The near-duplicate stage of the pipeline against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest

from shelfline.llm import near_copies, simhash


def sets_of(texts):
    out = []
    for t in texts:
        words = (t or "").lower().split()
        out.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def kept_by_all_pairs(rows):
    """The kept ids: the least of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets, root = sets_of([r[1] for r in rows]), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or both >= 0.8 * either - 1e-9:
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(least.values())


def planted(seed=5):
    """Originals, copies with a few changed words around the bound, and a large group of near copies."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = ["", None, "one two", "One  two", "one two three"]
    for n in (40, 80, 200, 400):
        for _ in range(12):
            words = rnd.choices(vocabulary, k=n)
            texts.append(" ".join(words))
            for changes in (1, 2, 3, 5):
                copy = list(words)
                for at in rnd.sample(range(n), changes):
                    copy[at] = rnd.choice(vocabulary)
                texts.append(" ".join(copy))
    base = rnd.choices(vocabulary, k=100)
    for _ in range(40):
        copy = list(base)
        copy[rnd.randrange(100)] = rnd.choice(vocabulary)
        texts.append(" ".join(copy))
    rnd.shuffle(texts)
    return [(i, t, "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("block,shingles", [(512, 4 << 20), (8, 4 << 20), (512, 500)])
def test_stage_is_all_pairs(spark, folder, documents, monkeypatch, block, shingles):
    monkeypatch.setattr(near_copies, "SHINGLES", shingles)
    monkeypatch.setattr(near_copies.classes, "__defaults__", (near_copies.SHINGLE, near_copies.SIMILARITY, block))
    rows = planted()
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    df = documents(rows)
    out = stage(spark, df, folder)
    assert out.dtypes == df.dtypes
    assert sorted(r.doc_id for r in out.collect()) == kept_by_all_pairs(rows)


def test_stage_on_tables(spark, folder, messy, no_documents):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in stage(spark, docs, folder).collect()) == kept_by_all_pairs(rows)
    assert stage(spark, no_documents, folder).count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in stage(spark, messy, folder).collect())[0][:2] == (False, 1)


def test_groups_of_equal_size_are_told_apart_by_their_members(spark, monkeypatch):
    """Pairs that would collide in one sum of hashes modulo a small number stay two groups."""
    rows = [(k, 2 * k + i) for k in range(2000) for i in range(2)]
    marked = spark.createDataFrame(rows, "key long, fp long").groupBy("key").agg(*near_copies._member_marks())
    assert marked.select("mark", "mark2").distinct().count() == 2000
    assert {t for _, t in marked.select("mark", "mark2").dtypes} == {"decimal(30,0)"}


def test_simhash_finds_candidates_that_share_no_key(spark, folder, documents, monkeypatch):
    """Long texts and copies with one changed word, and no keys at all."""
    monkeypatch.setattr(near_copies, "keys_of", lambda tokens: np.zeros(0, np.int64))
    rnd = random.Random(7)
    rows = []
    for i in range(4):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(20_000)]
        changed = [*words[:9000], "changed", *words[9001:]]
        rows += [(10 * i, " ".join(words), "s"), (10 * i + 1, " ".join(changed), "s")]
    linked = [simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1]) for a, b in zip(rows[::2], rows[1::2])]
    near = [i for i, bits in enumerate(linked) if bits.bit_count() <= simhash.DISTANCE]
    assert near
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = {r.doc_id for r in stage(spark, documents(rows), folder).collect()}
    assert kept == {r[0] for r in rows} - {10 * i + 1 for i in near}

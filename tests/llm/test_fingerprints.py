"""Consistent weighted sampling against counted similarities."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from shelfline.llm import fingerprints


def weights(text):
    return Counter(re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()))


def jaccard(a, b):
    a, b = weights(a), weights(b)
    if not a and not b:
        return 1.0
    return sum((a & b).values()) / sum((a | b).values())


def edits(rows):
    """Every document, its text edited, and the next document."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        k = len(text) // 4
        out.append((doc_id, text, text[: len(text) - k] + after[:k], after))
    return out


def test_collision_rate_is_generalised_jaccard():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    pairs = []
    for n in (5, 30, 200, 2000):
        for _ in range(30):
            a = rnd.choices(words, k=n)
            b = [w if rnd.random() < 0.7 else rnd.choice(words) for w in a] + rnd.choices(words, k=rnd.randrange(n))
            pairs.append((" ".join(a), " ".join(b)))
    a, b = (fingerprints.signatures([p[i] for p in pairs], 512) for i in (0, 1))
    near = fingerprints.likeness(*a, *b)
    true = np.array([jaccard(*p) for p in pairs])
    off = near - true
    assert abs(off.mean()) < 0.01 and np.abs(off).max() < 4.5 * np.sqrt(0.25 / 512)


def test_a_text_has_one_fingerprint():
    texts = ["", " \t ", "one", "One  ONE two", "two one one", "é É", "long " * 5000 + "x" * 100_000]
    alone = [fingerprints.shown(*fingerprints.signatures([t]))[0] for t in texts]
    assert alone == fingerprints.shown(*fingerprints.signatures(texts))
    assert alone[0] == alone[1] == "" and alone[3] == alone[4] and len(alone[2]) == 4 * fingerprints.SAMPLES


def check(df, rows):
    found = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(found) == len(rows)
    near = []
    for r, (doc_id, text, changed, after) in zip(found, edits(rows)):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == fingerprints.shown(*fingerprints.signatures([text]))[0]
        assert r.edited_fingerprint == fingerprints.shown(*fingerprints.signatures([changed]))[0]
        near += [(r.near_edited, jaccard(text, changed)), (r.near_next, jaccard(text, after))]
    off = np.array([a - b for a, b in near])
    assert np.abs(off).max() < 5 * np.sqrt(0.25 / fingerprints.SAMPLES)


def test_edits_of_the_table(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    check(fingerprints.fingerprint_edits(table), sorted((r.doc_id, r.text) for r in table.collect()))


def test_edits_in_many_ranges(spark, documents, monkeypatch):
    monkeypatch.setattr(fingerprints, "TOGETHER", 200)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["a", "b", "é", "dd"], k=rnd.randrange(60))) if i % 9 else None) for i in range(1, 80)]
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        check(fingerprints.fingerprint_edits(documents([(*r, "s") for r in rows])), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edits_of_messy_rows(messy, no_documents, documents):
    assert fingerprints.fingerprint_edits(no_documents).count() == 0 and fingerprints.fingerprints(no_documents).count() == 0
    found = fingerprints.fingerprint_edits(messy).collect()
    assert len(found) == messy.count() and sorted(r.fingerprint for r in fingerprints.fingerprints(messy).collect()) == sorted(r.fingerprint for r in found)
    alone = fingerprints.fingerprint_edits(documents([(1, "abcdefgh", "s")])).collect()
    assert [(r.near_next, r.edited_sha256) for r in alone] == [(1.0, hashlib.sha256(b"abcdefab").hexdigest())]

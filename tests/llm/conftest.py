from __future__ import annotations

import pytest

CLASHING = ("text_key", "key", "row", "size", "copies", "n", "near", "label", "text_id", "redacted", "scored_text", "fp")


@pytest.fixture
def documents(spark):
    """Rows of ``doc_id, text, source`` as a table with further columns of awkward names."""

    def make(rows):
        names = ", ".join(f"{c} string" for c in CLASHING)
        full = [(*r, *["x"] * len(CLASHING)) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, source string, {names}").repartition(3)

    return make


@pytest.fixture
def messy(documents):
    """Nulls, empty and blank texts, repeated rows, one id with two texts, and a very long text."""
    long = " ".join(f"word{i % 9973} of{i}" for i in range(30_000))
    repeated = "the same row again " * 30
    return documents(
        [
            (None, None, None),
            (None, "no id here", "a"),
            (1, None, "a"),
            (2, "", None),
            (3, " \n\t ", "b"),
            (4, "one", "b"),
            (5, repeated, "b"),
            (5, repeated, "b"),
            (6, repeated, "c"),
            (7, "first text of an id", "c"),
            (7, "second text of an id", None),
            (8, long, "d"),
            (9, "a" * 200_000, "d"),
            (10, "x" * 199 + "y", "d"),
        ]
    )


@pytest.fixture
def no_documents(documents):
    return documents([]).limit(0)


@pytest.fixture
def folder():
    import os

    return os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

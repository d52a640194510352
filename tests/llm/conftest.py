from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """A small table with nulls, empty and long texts, repeated rows and columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "s", 10, 0.5, "x"),
        (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today", "en", "s", 10, 0.5, "x"),
        (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today", "en", "s", 10, 0.5, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "s", 0, 0.5, "x"),
        (None, "a text without an id, été", "fr", "s", 10, None, "x"),
        (5, "word " * 6000, "en", "s", 30000, 0.5, "x"),
        (6, "single", "en", "s", 6, 0.5, "x"),
        (7, " \n\t ", "en", "s", 4, 0.5, "x"),
        (8, "über straße über straße. Punkt, Komma! und mehr\nZeilen >> hier", "de", "s", 10, 0.5, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, block string")


@pytest.fixture
def empty(documents):
    return documents.limit(0)

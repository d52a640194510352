from __future__ import annotations

import hashlib
import re

import pytest

from lexmill.llm import decontaminate


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            for s in range(max(1, len(iw) - window + 1) if iw else 0):
                w = iw[s : s + window]
                for i in range(len(own) - len(w) + 1):
                    if own[i : i + len(w)] == w and item_id is not None:
                        hit |= set(range(i, i + len(w)))
                        found.add(item_id)
        listed = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "lazy dog near the old river bank TODAY"), (2, "one two three four five six seven eight nine ten eleven twelve"), (10, "single"), (11, None), (12, "..."), (2, "word word word word word word word word word word word"), (None, "quick brown")]


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_against_brute_force(spark, documents, empty, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    more = spark.createDataFrame([(20, "x one, two three four five six seven eight nine ten eleven y two three four five six seven eight nine ten eleven twelve", "", "", 0, 0.0, "")], documents.schema)
    docs = documents.union(more)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = sorted((tuple(r) for r in decontaminate.contamination(docs, items).collect()), key=str)
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert decontaminate.contamination(empty, items).count() == 0
    clean = decontaminate.contamination(docs, items.limit(0))
    assert clean.count() == docs.count() and clean.filter("contaminated").count() == 0


def test_only_clean_documents_stay(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminated(documents, items)
    assert kept.columns == documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "7", "8", "None"]


def test_only_the_hit_rows_of_an_id_go(spark):
    rows = [(None, "clean"), (None, "a SINGLE hit"), (None, "clean too"), (None, None), (7, "nothing here"), (7, "another single one"), (7, "nothing here")]
    kept = decontaminate.decontaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted((r for r in rows if "single" not in (r[1] or "").lower()), key=str)


@pytest.mark.parametrize("size", [1, 2, 4, 5, 9])
def test_short_items(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0 if size % 2 else 500_000)
    item = " ".join(f"w{i}" for i in range(size))
    docs = [(1, f"a {item} b {item}"), (2, " ".join(f"w{i}" for i in range(size - 1)))]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, [(1, item)])


def test_the_prefix_is_the_rarest_shingle(spark):
    docs = spark.createDataFrame([(1, "a b c d e f " * 3 + "a b c d e g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f a b"), (2, "b c d e g h i")], "item_id long, text string")
    windows = decontaminate.benchmark_windows(items)
    # The second item has words that no document has; of the first, "f" stands three times and all others four times.
    (only,) = decontaminate._prefixes(docs, windows, 5).collect()
    assert only.item_id == 1 and "f" in only.w_words[only.w_offset : only.w_offset + 5]

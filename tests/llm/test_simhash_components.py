from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import simhash
from lexmill.llm.components import components


def fingerprint(text):
    words = [w for w in _split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return text.split(" ")


def linked_groups(prints, ids, radius):
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                group[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(len(prints)):
        members.setdefault(root(i), []).append(ids[i])
    return [min((x for x in members[root(i)] if x is not None), default=None) for i in range(len(prints))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab Ä\n\x1c", max_size=30)), min_size=1, max_size=8))
def test_fingerprints(texts):
    assert simhash.fingerprints(pa.array(texts, pa.string())).to_numpy().view(np.uint64).tolist() == [fingerprint(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.lists(st.integers(0, 63), max_size=60), st.integers(0, 2), st.integers(1, 200))
def test_bit_sliced_pairs(base, flips, radius, at_once):
    values = list(base)
    for n, bit in enumerate(flips):
        values.append(values[n % len(values)] ^ (1 << bit))
    array = np.array(values, dtype=np.uint64)
    sizes = np.array([len(values) // 2, len(values) - len(values) // 2])
    sizes = sizes[sizes > 0]
    group = np.repeat(np.arange(len(sizes)), sizes)
    found = {(int(i), int(j)) for a, b in simhash.near_pairs(array, sizes, radius, at_once) for i, j in zip(a, b)}
    assert found == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if group[i] == group[j] and bin(values[i] ^ values[j]).count("1") <= radius}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_with_and_without_hot_buckets(spark, documents, empty):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    prints = [fingerprint(t) for _, t in rows]
    expected = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, linked_groups(prints, [i for i, _ in rows], 2))), key=str)
    for hot in (4096, 1):
        found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents, hot=hot).collect()), key=str)
        assert found == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(spark, documents):
    kept = simhash.deduplicated(documents)
    assert kept.columns == documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "6", "8", "None"]


LONG = " ".join(f"w{i}" for i in range(400))
ROWS = [
    (None, "alpha beta gamma delta", "a"), (None, "one two three four five", "b"), (None, "one two three four five", "c"), (None, "ein anderer Text ganz ohne Nummer", "d"), (None, None, "e"), (None, "", "f"),
    (1, LONG, "g"), (2, LONG, "h"), (2, "a second text under the same number", "i"), (2, "and a third one, unlike both", "j"), (None, LONG, "k"),
]


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, block string").repartition(3)
    groups = linked_groups([fingerprint(t) for _, t, _ in ROWS], [n for n, _ in enumerate(ROWS)], 2)
    for hot in (4096, 1):
        kept = simhash.deduplicated(docs, hot=hot)
        assert kept.columns == docs.columns
        rows = kept.collect()
        place = {block: n for n, (_, _, block) in enumerate(ROWS)}
        assert sorted(groups[place[r.block]] for r in rows) == sorted(set(groups))
        assert {(r.doc_id, r.text) for r in rows} >= {(1, LONG), ROWS[0][:2], ROWS[1][:2], ROWS[3][:2], ROWS[8][:2], ROWS[9][:2]} and (2, LONG) not in {(r.doc_id, r.text) for r in rows}

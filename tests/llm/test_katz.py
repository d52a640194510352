from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import katz
from lexmill.llm.arrays import pack_arrays, sorted_pairs, unpack_arrays
from lexmill.llm.files import read_range

WORDS = ["the", "a", "fox", "dog", "Über", "runs", "home", "x\x1dy", "é"]


def corpus(n=120):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(WORDS[j] for j in rng.zipf(1.5, rng.integers(0, 25)) % len(WORDS)) + (" rare%d" % i if i % 3 == 0 else "")) for i in range(n)]
    return [*rows, (500, None), (501, ""), (502, " \t\n"), (7, rows[7][1]), (None, "the fox")]


def tokens(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ") if w] + ["\n"]


class Plain:
    """The model from plain counters."""

    def __init__(self, rows, order):
        self.train = [tokens(t or "") for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
        self.counts = {1: Counter(w for d in self.train for w in d)}
        self.followers = {}
        for n in range(2, order + 1):
            padded = [["\t"] * (n - 1) + d for d in self.train]
            self.counts[n] = Counter(tuple(p[i : i + n]) for p, d in zip(padded, self.train) for i in range(len(d)))
            self.followers[n] = {}
            for gram, c in self.counts[n].items():
                self.followers[n].setdefault(gram[:-1], []).append((gram[-1], c))
        coc = lambda c: [Counter(c.values()).get(r, 0) for r in range(8)]
        self.total, self.distinct = sum(self.counts[1].values()), len(self.counts[1])
        self.unigrams = katz.Unigrams.of(self.total, self.distinct, len(self.train), coc(self.counts[1]))
        self.discounts = {n: katz.Discounts.of(coc(self.counts[n])) for n in range(2, order + 1)}

    @cache
    def history(self, n, h):
        seen = np.array([[sum(c == r for _, c in self.followers[n][h])] for r in range(1, 6)], dtype=float)
        many = sum(c for _, c in self.followers[n][h] if c > 5)
        lower = sum(self.p(n - 1, h[1:], w) for w, _ in self.followers[n][h])
        divisor, alpha = katz.history_weights(np.array([float(sum(c for _, c in self.followers[n][h]))]), seen, np.array([float(many)]), np.array([lower]), self.discounts[n])
        return float(divisor[0]), float(alpha[0])

    def p(self, n, h, w):
        if n == 1:
            return float(self.unigrams.p(np.array([self.counts[1].get(w, 0)]))[0])
        if h not in self.followers[n]:
            return self.p(n - 1, h[1:], w)
        divisor, alpha = self.history(n, h)
        c = self.counts[n].get((*h, w), 0)
        return float(self.discounts[n].discounted(np.array([c]))[0]) / divisor if c else alpha * self.p(n - 1, h[1:], w)


@pytest.mark.parametrize(("order", "hot", "block", "parts"), [(2, 1_000_000, 2_500_000, 1), (3, 20, 300, 2), (4, 15, 200, 3)])
def test_scores_and_normalisation(spark, monkeypatch, order, hot, block, parts):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "PARTS", parts)
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string").repartition(3)
    model = katz.train(frame, order)
    plain = Plain(rows, order)
    found = sorted((tuple(r) for r in model.scores().collect()), key=str)
    expected = []
    for i, text in rows:
        own = tokens(text or "")
        padded = ["\t"] * (order - 1) + own
        score = sum(math.log10(plain.p(order, tuple(padded[k : k + order - 1]), padded[k + order - 1])) for k in range(len(own)))
        base = sum(math.log10((plain.counts[1].get(w, 0) + 1) / (plain.total + plain.distinct + 1)) for w in own)
        expected.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(own), sum(w in plain.counts[1] for w in own), plain.total, base, score))
    for a, b in zip(found, sorted(expected, key=str), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    for n in range(2, order + 1):
        for h in list(plain.followers[n])[:40]:
            assert sum(plain.p(n, h, w) for w in plain.counts[1]) + plain.p(n, h, "never seen") == pytest.approx(1)
        if hot == 1_000_000 or n < 4:
            assert sorted(r.n for r in model.counts(n).collect()) == sorted(plain.counts[n].values())
            # The stored weights, without the names of histories.
            found_weights = sorted((round(r.divisor, 6), round(r.alpha, 9)) for r in model.weights(n).collect())
            assert found_weights == sorted((round(d, 6), round(a, 9)) for d, a in (plain.history(n, h) for h in plain.followers[n]))


def test_held_out_text_is_likelier_than_by_the_base(spark):
    scores = katz.op1(spark, "/root/testdata/sf0.001").filter("held_out").collect()
    assert len(scores) > 20 and sum(r.score for r in scores) > sum(r.base_score for r in scores)


def test_registered_model_has_trigrams(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain, expected = Plain(rows, 3), []
    for i, text in rows:
        padded = ["\t"] * 2 + tokens(text or "")
        expected.append((str(i), sum(math.log10(plain.p(3, tuple(padded[k : k + 2]), padded[k + 2])) for k in range(len(padded) - 2))))
    found = sorted((str(r.doc_id), r.score) for r in katz.op1(spark, str(tmp_path)).collect())
    for a, b in zip(found, sorted(expected), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz.train(none).scores().count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2**40)] * 3), max_size=40))
def test_sorted_groups(rows):
    columns = [np.array(c, np.uint64) for c in zip(*rows)] or [np.zeros(0, np.uint64)]
    order, opens = katz.sorted_groups(columns)
    ordered = [rows[i] for i in order.tolist()] if rows else []
    assert ordered == sorted(rows) and int(opens.sum()) == len(set(rows))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.sampled_from([0.5, 0.25, 1e-9]), max_size=50))
def test_packed_arrays(numbers, floats):
    out = unpack_arrays(pack_arrays(a=np.array(numbers, np.uint64), b=np.array(floats, np.float64), c=np.array([], bool)))
    assert out["a"].tolist() == numbers and out["b"].tolist() == floats and len(out["c"]) == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=40), st.sampled_from([9, 2**31]))
def test_sorted_pairs(pairs, top):
    left, right = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    keys, at = sorted_pairs(left, right, np.arange(len(pairs)), top, top)
    assert at.tolist() == sorted(range(len(pairs)), key=lambda i: (pairs[i], i))
    assert np.flatnonzero(keys[1:] != keys[:-1]).tolist() == [i for i in range(len(at) - 1) if pairs[at[i]] != pairs[at[i + 1]]]


def test_a_block_hashes_each_history_once(tmp_path, monkeypatch):
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["the fox runs home " * 500], "test": [False]})
    (row,) = [r for b in katz._make_blocks(tmp_path.as_uri())(iter([batch])) for r in b.to_pylist()]
    data = unpack_arrays(read_range(row["uri"]))
    n = np.bincount(data["tokens"].astype(np.int64))[np.argsort(data["words"])].astype(np.uint64)
    block = katz.Block(row["uri"], {0: {"ids": np.arange(5, dtype=np.uint64) + 2, "n": n}}, 1, katz.Unigrams.of(2001, 5, 1, [0] * 8))
    hashed, mixed = [], katz.mixed
    monkeypatch.setattr(katz, "mixed", lambda a, b: hashed.append(len(a)) or mixed(a, b))
    block.lay_out()
    assert sorted(block.times.tolist()) == [1, 1, 499, 500, 500, 500] and max(hashed) == 5

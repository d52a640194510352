from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexmill.llm import alignment, ballkmeans, passages
from lexmill.llm.common import hot_keys, join_hot
from lexmill.llm.tokens import tokenizer_path

BITS = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "B", "word", "Word.", "x,", "é", "日本", "🎉", "'s", "it's", "12", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "▁a", "ﬁ", "\r\n", "\x00", "unbelievable", "ß"]


class Plain:
    """Whole texts through both libraries, links by walking over both sides."""

    def __init__(self) -> None:
        self.a = Tokenizer.from_file(tokenizer_path(alignment.TOKENIZER_A))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=tokenizer_path(alignment.TOKENIZER_B))

    def bytes_a(self, i: int) -> bytes:
        return alignment.byte_level_bytes(self.a.id_to_token(i))

    def bytes_b(self, i: int) -> bytes:
        return alignment.piece_bytes(self.b.id_to_piece(i))

    def align(self, text: str | None):
        """(links, groups text, n_a, n_b, n_groups)"""
        a, b = (self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)) if text else ([], [])
        whole = b" " + (text or "").encode()
        if not text or b"".join(map(self.bytes_a, a)) != whole or b"".join(map(self.bytes_b, b)) != whole:
            return [], "", 0, 0, 0
        spans_a, spans_b = [], []
        for ids, told, spans in ((a, self.bytes_a, spans_a), (b, self.bytes_b, spans_b)):
            at = 0
            for i in ids:
                spans.append((at, at + len(told(i)), i))
                at += len(told(i))
        links = [(x[2], y[2]) for x in spans_a for y in spans_b if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans_a} & {y[1] for y in spans_b})
        groups = []
        for start, end in zip([0, *ends], ends):
            inside = lambda spans: ",".join(str(i) for p, q, i in spans if start <= p and q <= end)  # noqa: B023, E731
            groups.append(f"{inside(spans_a)}|{inside(spans_b)}")
        return links, ";".join(groups), len(a), len(b), len(groups)


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def aligner():
    return alignment.chunk_aligner(tokenizer_path(alignment.TOKENIZER_A), tokenizer_path(alignment.TOKENIZER_B))


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.none() | st.lists(st.sampled_from(BITS), max_size=12).map("".join), min_size=1, max_size=6))
def test_chunks_align_like_whole_texts(plain, aligner, texts):
    found = alignment.align_texts(pa.array(texts, pa.string()), aligner)
    expected = [plain.align(t) for t in texts]
    assert found.groups == [e[1] for e in expected]
    assert found.counts.T.tolist() == [[e[2], e[3], e[4], len(e[0])] for e in expected]
    postings = Counter((i, link) for i, e in enumerate(expected) for link in e[0])
    assert {(int(t), (int(p) >> 32, int(p) & 0xFFFFFFFF)): int(n) for p, t, n in zip(found.pair, found.text, found.times)} == postings


def _plain_alignment(plain, rows):
    aligned = [plain.align(r["text"]) for r in rows]
    counts = Counter(link for a in aligned for link in set(a[0]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for row, (links, groups, n_a, n_b, n_groups) in zip(rows, aligned):
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((row["doc_id"], n_a, n_b, n_groups, len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), digest))
    return sorted(out, key=repr)


def test_alignment_of_a_table(spark, documents, empty, plain):
    more = documents.unionByName(spark.createDataFrame([(100 + i, f"words of document {i} and ▁" if i % 7 == 0 else f"words, of document {i}", None, None, None, None, None) for i in range(60)], documents.schema))
    for options in ({}, {"slices": 3, "group_postings": 5}):
        found = alignment.Alignment(more, **options)
        assert sorted(map(tuple, found.documents().collect()), key=repr) == _plain_alignment(plain, more.collect())
    assert sorted(map(tuple, found.groups().collect()), key=repr) == sorted(((r["doc_id"], plain.align(r["text"])[1]) for r in more.collect()), key=repr)
    assert alignment.Alignment(empty).documents().collect() == []


def _removed(rows: list[tuple[int, list]], window: int) -> list[set[int]]:
    """Places that go, by looking at every window of every document."""
    first: dict[tuple, int] = {}
    for doc, words in rows:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    return [{p for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < doc for p in range(i, i + window)} for doc, words in rows]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.lists(st.integers(0, 2), min_size=1, max_size=24)), min_size=1, max_size=8), st.integers(1, 6))
def test_greedy_factors_and_their_ends_find_every_repeated_window(rows, window):
    rows = sorted(rows, key=lambda r: r[0])
    block = passages.ReferenceBlock([np.array(w, dtype=np.uint64) for _, w in rows], np.array([d for d, _ in rows]))
    place, length = block.spans(window)
    found = [{p - first for start, n in zip(place.tolist(), length.tolist()) for p in range(start, start + n) if first <= p < end} for first, end in zip(block.first.tolist(), block.end.tolist())]
    assert found == _removed(rows, window)
    starts, lengths = block.factors()
    covered = sorted(p for s, n in zip(starts.tolist(), lengths.tolist()) for p in range(s, s + n))
    assert covered == [p for first, end in zip(block.first.tolist(), block.end.tolist()) for p in range(first, end)]  # factors tile the sequences


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=6), st.integers(1, 5), st.integers(0, 5))
def test_every_window_is_in_one_phrase_and_equal_ones_share_the_seed(documents, seed, more):
    window = seed + more
    words = np.array([w + 1 for d in documents for w in d], dtype=np.uint64)
    counts = np.array([len(d) for d in documents])
    found = passages.phrases(words, counts, window, seed)
    seeds: dict[tuple, int] = {}
    met = Counter()
    for d, s, start, n in zip(found["document"].tolist(), found["seed"].tolist(), found["start"].tolist(), found["windows"].tolist()):
        for i in range(start, start + n):
            met[d, i] += 1
            assert seeds.setdefault(tuple(documents[d][i : i + window]), s) == s
    assert met == Counter((d, i) for d, w in enumerate(documents) for i in range(len(w) - window + 1))
    texts = [tuple(documents[d][a : a + n + window - 1]) for d, a, n in zip(found["document"].tolist(), found["start"].tolist(), found["windows"].tolist())]
    assert len(set(zip(texts, found["phrase"].tolist()))) == len(set(texts)) == len(set(found["phrase"].tolist()))


@pytest.mark.parametrize("options", [{}, {"hot_phrases": 1, "block_words": 60}], ids=["blocks", "hot"])
def test_passages_of_a_table(spark, documents, empty, options):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [list(rng.choice(vocabulary, 30)) for _ in range(4)]
    rows = []
    for i in range(80):
        parts = [list(rng.choice(vocabulary, rng.integers(0, 15))), shared[rng.integers(4)], list(rng.choice(vocabulary, rng.integers(0, 15))), shared[rng.integers(4)][: rng.integers(5, 30)]]
        rows.append((int(rng.integers(100, 160)), "\n ".join(w for p in parts for w in p), None, None, None, None, None))
    table = documents.unionByName(spark.createDataFrame([*rows, *rows[:3]], documents.schema))
    texts = [(r["doc_id"], (r["text"] or "").replace("\n", " ").replace("\t", " ").split()) for r in table.collect()]
    gone = _removed([(passages.LAST_ID if d is None else d, w) for d, w in texts], 12)
    expected = sorted(((d, len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for (d, w), g in zip(texts, gone)), key=repr)
    found = passages.without_repeats(table, window=12, seed=5, **options)
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert sum(map(len, gone)) > 500
    assert passages.without_repeats(empty).collect() == []


def test_hot_keys_are_dealt_over_salts(spark, monkeypatch):
    from lexmill.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    left = spark.range(200).selectExpr("id", "if(id % 2 = 0, 0, id) as k").cache()
    right = spark.range(0, 200, 3).selectExpr("id as k", "-id as v")
    hot = hot_keys(left.groupBy("k").count(), ["k"], "count", 200)
    assert [r["k"] for r in hot.collect()] == [0]
    from pyspark.sql import functions as F

    for how in ("inner", "left"):
        assert sorted(join_hot(left, right, ["k"], hot, F.col("id"), how).collect(), key=repr) == sorted(left.join(right, "k", how).select("k", "id", "v").collect(), key=repr)
    apart = join_hot(left, right, ["k"], hot, F.col("id"), "left", apart=F.col("id") % 5 == 0)
    assert apart.count() == 200 and apart.filter("id % 5 = 0 and v is not null").count() == 0


def _plain_kmeans(rows, k, rounds, scale, dimensions):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for j in range(len(centroids)):
            if own := [v for (_, v), c in zip(kept, of) if c == j]:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, nearest(v), far(v, centroids[nearest(v)])) for i, v in kept]
    inertia = Counter()
    for _, c, d in last:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in last), key=repr)


def test_ball_kmeans_equals_plain_rounds(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 4, (6, 3))
    points = [[float(x) for x in np.round(middles[i % 6] + rng.normal(0, 0.3, 3), 1)] for i in range(150)]  # rounded, so that distances tie
    rows = [(i, p) for i, p in enumerate(points)] + [(3, points[3]), (None, points[5]), (None, points[9]), (200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 1.0, 2.0]), (205, [0.0, 0.0, 0.0]), (206, [])]
    table = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    for k, rounds in ((6, 5), (1, 2), (40, 3), (500, 1), (7, 0)):
        found = ballkmeans.clustered(table, k, rounds, dimensions=3, scale=16)
        assert sorted(map(tuple, found.collect()), key=repr) == _plain_kmeans(rows, k, rounds, 16, 3)
    assert ballkmeans.clustered(table.limit(0), 6, dimensions=3).collect() == []
    met = ballkmeans.ball_kmeans(table, 24, 5, dimensions=3, scale=16).assigned.agg({"compared": "avg"}).first()[0]
    assert met < 16  # of 24 centroids, in six groups that lie apart


def test_vectors_too_large_for_exact_distances_are_refused(spark):
    table = spark.createDataFrame([(1, [1e6, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit 64 bits"):
        ballkmeans.clustered(table, 1, dimensions=2).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=40), st.integers(1, 6), st.randoms())
def test_members_meet_every_centroid_that_could_be_nearer(points, k, random):
    vectors = np.array(points, dtype=np.int32)
    centroids = np.array([random.choice(points) for _ in range(k)], dtype=np.int64)
    cluster = np.array([random.randrange(k) for _ in points], dtype=np.int32)
    far = np.array([ballkmeans.squared_distances(vectors, c) for c in centroids])
    radii = [math.isqrt(int(far[j][cluster == j].max(initial=0))) + 1 for j in range(k)]
    new, distance, _ = ballkmeans.assign(vectors, cluster, centroids, ballkmeans.neighbours(centroids, radii))
    assert new.tolist() == far.argmin(axis=0).tolist() and distance.tolist() == far.min(axis=0).tolist()

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmill.llm import packing, repair, tokens
from lexmill.llm.tokens import ChunkTokenizer, tokenizer_path

BITS = ["a)", "wordy!", "b;", "Up?", "it:", "é!", "'s!", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "B", "word", "Word.", "x,", "y..", "é", "é", "İ", "ſ", "日本", "🎉", "'s", "it's", "1", "12", "<|endoftext|>", "<|STARTOFTEXT|>", "!!", "ß", "\r\n", "\x00"]
CASES = [("word_bpe_49k.json", "words", 1), ("byte_bpe_50k.json", "spaced", 0)]


@pytest.fixture(scope="module", params=CASES, ids=lambda c: c[1])
def both(request):
    name, cut, end = request.param
    return ChunkTokenizer(tokenizer_path(name), cut), Tokenizer.from_file(tokenizer_path(name)), end


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join), min_size=1, max_size=6))
def test_chunks_give_the_ids_of_whole_texts(both, texts):
    chunked, plain, end = both
    ids, counts = chunked.encode(texts, end)
    expected = [[*e.ids, end] for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


SIGNED = ["é$$$", "Éa!!", "x'.", "'s.", "µ]", "ªº", "İ.", "ß\\", "a|.", "a<.", "<|endoftext|>.", "$$$", "ﬁ.", "œ!!", "e\u0301.", "d,###", "que,ks", "A_", "1.", "À", " ", " ", " ", "\n"]


@settings(max_examples=300, deadline=None)
@given(batches=st.lists(st.lists(st.lists(st.sampled_from(SIGNED), max_size=12).map("".join), min_size=1, max_size=4), min_size=1, max_size=4))
def test_signs_and_latin_letters_in_a_small_cache(both, batches):
    chunked, plain, end = both
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "CACHE_CHUNKS", 6)
        for texts in batches:
            ids, counts = chunked.encode(texts, end)
            expected = [[*e.ids, end] for e in plain.encode_batch(texts, add_special_tokens=False)]
            assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


@pytest.mark.parametrize(("name", "cut", "end"), CASES)
def test_known_parts_are_not_encoded_again(name, cut, end, monkeypatch):
    """Chunks that came again outlast a full cache, and runs of signs are encoded once for all words before them."""
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 24)
    chunked, each, plain = ChunkTokenizer(tokenizer_path(name), cut), [], []
    whole, model = chunked._encode_each, chunked._encode_plain
    monkeypatch.setattr(chunked, "_encode_each", lambda chunks: each.extend(chunks) or whole(chunks))
    monkeypatch.setattr(chunked, "_encode_plain", lambda chunks: plain.extend(chunks) or model(chunks))
    for i in range(8):
        chunked.encode(["a tone " + " ".join(f"{c}{chr(97 + i)}é$$$" for c in "bcdfghj")], end)
    assert each.count("$$$") == 1 and len(each) == (cut == "spaced") + 1 and plain.count(" tone" if cut == "spaced" else "tone") == 1


def _times(symbols, pair):
    """How often a pair stands in symbols without overlapping itself."""
    n = i = 0
    while i + 1 < len(symbols):
        hit = (symbols[i], symbols[i + 1]) == pair
        n, i = n + hit, i + 1 + hit
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=30), max_size=12), st.integers(2, 3))
def test_repair_round_trip_and_no_pair_left(documents, min_count):
    ids = np.array([x for d in documents for x in d], dtype=np.uint32)
    n_ids = np.array([len(d) for d in documents], dtype=np.int64)
    symbols, per_document, rules = repair.compress(ids, n_ids, first_rule=10, min_count=min_count)
    plain = lambda x: [x] if x < 10 else [z for y in rules[x - 10].tolist() for z in plain(y)]
    assert [y for x in symbols.tolist() for y in plain(x)] == ids.tolist() and per_document.sum() == len(symbols)
    assert repair.expansion_lengths(rules, 10).tolist() == [len(plain(10 + i)) for i in range(len(rules))]
    cuts = np.concatenate(([0], np.cumsum(per_document))).tolist()
    own = [symbols[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    assert all(sum(_times(d, pair) for d in own) < min_count for pair in {p for d in own for p in zip(d, d[1:])})


def test_repeated_passages_become_few_symbols():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 40_000, 3000)
    ids = np.concatenate([passage, rng.integers(0, 40_000, 500), passage]).astype(np.uint32)
    symbols, _, rules = repair.compress(ids, np.array([len(ids)]), 49_408)
    assert len(symbols) < 520 and repair.expansion_lengths(rules, 49_408).max() == 3000


def test_random_access():
    rng = np.random.default_rng(0)
    n_ids = rng.integers(1, 50, 60)
    ids = rng.integers(0, 5, n_ids.sum()).astype(np.uint32)
    shard = repair.Shard(repair.shard_bytes(np.arange(60), np.zeros(60, bool), ids, n_ids, 50_000))
    cuts = np.concatenate(([0], np.cumsum(n_ids)))
    assert len(shard.rules) > 0
    for a, b in ((0, 60), (7, 8), (59, 60), (5, 5), (10, 40)):
        assert shard.decode(a, b).tolist() == ids[cuts[a] : cuts[b]].tolist()


def _ids(name, text, end):
    return np.array([*Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


@pytest.mark.parametrize(("name", "cut", "end"), [("word_bpe_49k.json", "words", 1), ("byte_bpe_50k.json", "spaced", 60_000)])
def test_shards_of_any_vocabulary(documents, name, cut, end):
    """Ids above the smaller vocabulary, and an end id above both, come back as they were."""
    plain = Tokenizer.from_file(tokenizer_path(name))
    found = repair.read_shards(repair.write_shards(documents, tokenizer_path(name), end, cut)).collect()
    expected = []
    for r in documents.collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, end], dtype="<u4")
        expected.append((r["doc_id"], len(ids), zlib.crc32(ids)))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=repr) == sorted(expected, key=repr)
    starts = sorted((r["start"], r["n_tokens"]) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_ids_beyond_the_vocabulary_are_refused():
    with pytest.raises(ValueError, match="no id of a vocabulary"):
        repair.shard_bytes(np.arange(1), np.zeros(1, bool), np.array([12], np.uint32), np.array([1]), 12)


def test_shards_in_order(documents, empty):
    found = repair.read_shards(repair.write_shards(documents)).collect()
    rows = sorted(documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    expected, start = [], 0
    for r in rows:
        ids = _ids(repair.TOKENIZER, r.text, 1)
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    assert repair.read_shards(repair.write_shards(empty)).count() == 0


def plain_best_two_fit(lengths, capacity):
    left, bins = sorted(lengths), []
    while left:
        chosen = []
        while fits := [x for x in left if x <= capacity - sum(chosen)]:
            chosen.append(fits[-1])
            left.remove(fits[-1])
        gap = capacity - sum(chosen)
        room, pairs = gap + chosen[-1], []
        for i, a in enumerate(left):
            pairs += [(a + b, a, b) for b in left[i + 1 :] if a + b <= room]
        best = max(pairs, default=(0,))[0]
        if gap and best > chosen[-1]:
            left.append(chosen.pop())
            for x in min((min(a, b), max(a, b)) for total, a, b in pairs if total == best):
                chosen.append(x)
                left.remove(x)
            left.sort()
        bins.append(sorted(chosen))
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=25))
def test_best_two_fit_by_the_plain_rule(lengths):
    bins, _ = packing.best_two_fit(np.array(lengths, dtype=np.int64), 20)
    held = defaultdict(list)
    for n, b in zip(lengths, bins.tolist()):
        held[b].append(n)
    assert sorted(sorted(v) for v in held.values()) == plain_best_two_fit(lengths, 20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_two_fit_places_everything(lengths):
    bins, offsets = packing.best_two_fit(np.array(lengths, dtype=np.int64), 20)
    held = defaultdict(list)
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
        held[b].append((o, n))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 20
    assert len(held) <= 2 * sum(lengths) / 20 + 1


def test_two_smaller_pieces_fill_the_gap():
    # Greedy: 6 + 3 leaves 1; then 3 goes for 2 + 2 of the gap of 4.
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(np.array([6, 3, 2, 2])[bins == bins[0]].tolist()) == [2, 2, 6]


def test_pack(documents, empty):
    pieces = packing.pack(documents, capacity=64).collect()
    text = {r.doc_id: r.text for r in documents.collect()}
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_document[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_document) == set(text)
    for doc_id, own in by_document.items():
        ids = _ids(packing.TOKENIZER, text[doc_id], 0)
        assert sum(p.length for p in own) == len(ids) * (2 if doc_id == 2 else 1)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and (p.piece == 0 or p.length == 64)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))] and sum(p.length for p in own) <= 64
    assert len(by_sequence) <= -(-sum(p.length for p in pieces) // 64) + 1
    assert packing.pack(empty).count() == 0


def test_sequences_are_nearly_full():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 2049, 4000), np.minimum(rng.zipf(1.3, 4000) * 7, 2048), rng.integers(600, 1100, 3000)):
        bins, _ = packing.best_two_fit(lengths)
        # No packing takes fewer sequences than the tokens fill, and none than pieces of over half a sequence.
        least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
        assert bins.max() + 1 <= 1.01 * least + 3 or lengths.min() >= 600 and bins.max() + 1 <= 1.3 * least

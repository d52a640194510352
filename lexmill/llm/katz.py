"""Katz backoff language model over n-grams of words, counted and evaluated in blocks.

P(w | h) = d(c) c(hw) / c(h) for an n-gram seen in training (Good-Turing: c* / c for counts up
to ``GT_MAX``, rescaled as Katz did so that larger counts stay whole), else alpha(h) P(w | h')
with the history h' that is one word shorter; the unigrams leave their Good-Turing mass to one
unknown word.  alpha(h) = (1 - sum of P(w | h) over the seen w) / (1 - sum of P(w | h') over the
same w), exactly, so every history sums to 1.  Where the discounts leave nothing (no count that
loses anything), one is added to c(h).

How it is spread: tasks turn documents into blocks of some million tokens, one file each; a block
holds training documents or held-out ones.  For each order a block sends its distinct n-grams to
the buckets their histories hash to, buckets add up and answer every block in the order it asked,
and the block's documents are evaluated with the answers.  No n-gram is a row of its own in a
shuffle, so the volume stays near that of the texts.  Training blocks send counts, and what the
bucket needs for the shorter history's probability (two counts, not the number itself); as all
their n-grams are seen, they are answered with counts alone.  Held-out blocks send no counts and
are told what alpha needs.  A history of more than ``HOT`` occurrences is salted by its next word over
several buckets, and its sums are added and joined as rows.

The model is kept as a table for each order, partitioned by the kind of its rows: ``model`` rows
hold a bucket's n-grams with their counts in sorted order (order 1: word hash, word id, count), see
``KatzModel.counts``; ``KatzModel.weights`` has every history's divisor and alpha.  Word ids are ranks by count
dealt over the buckets; words are known by their XXH64, n-grams by their word ids.

Defined cases: a null or empty text is one end token; a null doc_id is hashed as empty text;
rows of one id are rows of their own; without training documents every probability is 1.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.arrays import pack_arrays, sorted_pairs, unpack_arrays
from lexmill.llm.common import crc_bucket, materialize, new_path, table, with_scheme
from lexmill.llm.files import read_range, write_file
from lexmill.llm.words import numbered_words, slices_of

FOLDS, HELD_OUT = 7, 2
ORDER, GT_MAX = 3, 5
BLOCK_TOKENS, HOT, PARTS = 1_200_000, 1_000_000, 2
#: The end of a text; white space is in no word.
END = xxhash.xxh64_intdigest(" ")
#: Ids that are no word's: what stands before a document, and a word that training does not have.
BEGIN_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2
MESSAGE = "bucket long, block long, kind string, payload binary"


# ---------------------------------------------------------------- probabilities


@dataclass
class Discounts:
    """Good-Turing discounts of one order from its counts of counts."""

    d: np.ndarray  # d[c] for c in 0..GT_MAX; 1 beyond

    @staticmethod
    def of(counts_of_counts: list[int]) -> Discounts:
        """``counts_of_counts[r]``: how many n-grams have count r, for r up to GT_MAX + 1."""
        n, d = counts_of_counts, np.ones(GT_MAX + 1)
        common = (GT_MAX + 1) * n[GT_MAX + 1] / n[1] if n[1] else 1.0
        for r in range(1, GT_MAX + 1):
            if n[r] and common < 1:
                ratio = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
                if 0 < ratio <= 1:
                    d[r] = ratio
        return Discounts(d)

    @property
    def loses(self) -> np.ndarray:
        """Which counts are discounted at all."""
        return self.d < 1 - 1e-9

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        """d(c) c."""
        return np.where(counts > GT_MAX, 1.0, self.d[np.minimum(counts, GT_MAX)]) * counts


@dataclass
class Unigrams:
    discounts: Discounts
    total: int
    distinct: int
    documents: int
    unknown: float
    divisor: float

    @staticmethod
    def of(total: int, distinct: int, documents: int, counts_of_counts: list[int]) -> Unigrams:
        discounts = Discounts.of(counts_of_counts)
        lost = sum((1 - discounts.d[r]) * r * counts_of_counts[r] for r in range(1, GT_MAX + 1))
        divisor = total + (lost < 1e-9)
        return Unigrams(discounts, total, distinct, documents, (lost or 1.0) / divisor if lost >= 1e-9 else 1.0 / divisor, float(divisor))

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.discounted(counts) / self.divisor, self.unknown)


def history_weights(c_h: np.ndarray, seen: np.ndarray, many: np.ndarray, lower: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """(divisor of counts, alpha) of histories: ``seen[r - 1]`` n-grams of count r, ``many`` the sum
    of larger counts, ``lower`` the sum of the shorter history's probabilities of all that is seen."""
    kept = many + sum(discounts.d[r] * r * seen[r - 1] for r in range(1, GT_MAX + 1))
    divisor = c_h + ~np.any([(seen[r - 1] > 0) & discounts.loses[r] for r in range(1, GT_MAX + 1)], axis=0)
    return divisor, (1 - kept / divisor) / np.maximum(1 - lower, 1e-12)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit number of two."""
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def joined(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number of the ids of a history."""
    out = columns[0]
    for column in columns[1:]:
        out = mixed(out, column)
    return mixed(out, np.uint64(len(columns)) + np.zeros_like(out))


def sorted_groups(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the order that sorts rows by the columns, which rows in that order differ from the one before)."""
    keys: list[np.ndarray] = []
    used = 64
    for column in columns:  # as many columns in one key as have room
        width = max(1, int(column.max(initial=0)).bit_length())
        if used + width > 64:
            keys.append(column.astype(np.uint64))
            used = width
        else:
            keys[-1] = keys[-1] << np.uint64(width) | column
            used += width
    order = np.argsort(keys[-1])
    for key in reversed(keys[:-1]):
        order = order[np.argsort(key[order], kind="stable")]
    opens = np.zeros(len(order), bool)
    opens[:1] = True
    for key in keys:
        in_order = key[order]
        opens[1:] |= in_order[1:] != in_order[:-1]
    return order, opens


# ---------------------------------------------------------------- blocks


def _make_blocks(folder: str):
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: dict[bool, list] = {False: [], True: []}
        n_held = {False: 0, True: 0}

        def flush(test: bool) -> pa.RecordBatch:
            nonlocal number
            numbers, hashes, *rest = zip(*held[test])
            n_tokens, doc_ids, null_ids = map(np.concatenate, rest)
            words, number_of = np.unique(np.concatenate(hashes), return_inverse=True)
            parts = np.split(number_of, np.cumsum([len(h) for h in hashes])[:-1])
            tokens = np.concatenate([part[n] for part, n in zip(parts, numbers)])
            counts = np.bincount(tokens, minlength=len(words))
            by_count = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]  # small numbers for frequent words
            rank = np.empty(len(words), np.uint64)
            rank[by_count] = np.arange(len(by_count))
            data = pack_arrays(words=words[by_count], tokens=rank[tokens], n_tokens=n_tokens.astype(np.uint64), doc_ids=doc_ids, null_ids=null_ids, test=np.array([test]))
            row = {"block": (part << 24) | number, "uri": write_file(folder, f"{part:06d}-{number:04d}", data), "documents": 0 if test else len(n_tokens), "tokens": len(tokens)}
            held[test], n_held[test], number = [], 0, number + 1
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for first, last in slices_of(batch.column("text"), 4_000_000):
                part_of = batch.slice(first, last - first)
                numbers, words, counts = numbered_words(part_of.column("text"), lower=True)
                hashes = np.full(len(words) + 1, END, np.uint64)
                hashes[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))
                n_tokens = counts + 1
                tokens = np.full(int(n_tokens.sum()), len(words), np.int32)
                inside = np.ones(len(tokens), bool)
                inside[np.cumsum(n_tokens) - 1] = False
                tokens[inside] = numbers
                ids, is_test = part_of.column("doc_id"), part_of.column("test").to_numpy(zero_copy_only=False).astype(bool)
                doc_ids, null_ids, in_test = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), np.repeat(is_test, n_tokens)
                for test in (False, True):
                    if (is_test == test).any():
                        own = is_test == test
                        held[test].append((tokens[in_test == test], hashes, n_tokens[own], doc_ids[own], null_ids[own]))
                        n_held[test] += len(held[test][-1][0])
                        if n_held[test] >= BLOCK_TOKENS:
                            yield flush(test)
        for test in (False, True):
            if held[test]:
                yield flush(test)

    return run


def _messages(schema: list[tuple[int, int, str, bytes]]) -> pa.Table:
    bucket, block, kind, payload = zip(*schema) if schema else ((), (), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "block": pa.array(block, pa.int64()), "kind": pa.array(kind, pa.string()), "payload": pa.array(payload, pa.binary())})


def _runs(bucket: np.ndarray):
    """(bucket, first, last) of a sorted array of buckets."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])] if len(bucket) else []


# ---------------------------------------------------------------- order 1


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % buckets


def _by_bucket(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order in which a block asks for its words, their buckets in that order)."""
    bucket = _bucket_of(words, buckets)
    order = np.argsort(words)
    order = order[_sorting(bucket[order], buckets)]
    return order, bucket[order]


def _sorting(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The stable order by bucket."""
    return np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")


def _ask_words(buckets: int):
    """Each block's distinct words and their training counts, by bucket."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = unpack_arrays(read_range(row["uri"]))
                n = np.bincount(block["tokens"].astype(np.int64), minlength=len(block["words"])).astype(np.uint64) * np.uint64(not block["test"][0])
                order, bucket = _by_bucket(block["words"], buckets)
                out = [(b, row["block"], "ask", pack_arrays(words=np.diff(block["words"][order[x:y]], prepend=np.uint64(0)), n=n[order[x:y]])) for b, x, y in _runs(bucket)]
                yield from _messages(out).to_batches()

    return run


def _count_words(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        asked = [(row["block"], unpack_arrays(row["payload"])) for row in group.to_pylist()]
        bucket = group.column("bucket")[0].as_py()
        words, place = np.unique(np.concatenate([np.cumsum(a["words"], dtype=np.uint64) for _, a in asked]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([a["n"] for _, a in asked]), minlength=len(words)).astype(np.uint64)
        rank = np.empty(len(words), np.uint64)
        rank[np.lexsort((words, -n.astype(np.int64)))] = np.arange(len(words), dtype=np.uint64)
        ids = rank * np.uint64(buckets) + np.uint64(bucket + FIRST_ID)
        out, at = [], 0
        for block, a in asked:
            own = place[at : at + len(a["words"])]
            at += len(own)
            out.append((bucket, block, "answer", pack_arrays(ids=ids[own], n=n[own])))
        seen = n > 0
        out.append((bucket, -1, "model", pack_arrays(h1=words[seen], word=ids[seen], n=n[seen])))
        out.append((bucket, -1, "sums", pack_arrays(sums=np.array([n.sum(), seen.sum(), *np.bincount(n[n <= GT_MAX + 1].astype(np.int64), minlength=GT_MAX + 2)], dtype=np.uint64))))
        return _messages(out)

    return run


def _sums(answers: DataFrame) -> list[int]:
    """Totals over all buckets, added on the executors: a few numbers."""

    def run(batches):
        total = 0
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                total = total + unpack_arrays(payload)["sums"].astype(np.int64)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int64()), "n": pa.array(total, pa.int64())})

    rows = answers.filter(F.col("kind") == "sums").select("payload").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()
    return [r.n for r in rows] or [0] * (GT_MAX + 4)


# ---------------------------------------------------------------- higher orders


HISTORY_SUMS = ("many", "lower", *(f"seen{r}" for r in range(1, GT_MAX + 1)))


class Block:
    """A block's tokens with what the orders so far say of them."""

    def __init__(self, uri: str, answers: dict[int, dict[str, np.ndarray]], buckets: int, unigrams: Unigrams) -> None:
        data = unpack_arrays(read_range(uri))
        self.n_tokens, self.doc_ids, self.null_ids, self.test = data["n_tokens"].astype(np.int64), data["doc_ids"], data["null_ids"], bool(data["test"][0])
        order, _ = _by_bucket(data["words"], buckets)
        ids, n = np.empty(len(order), np.uint64), np.empty(len(order), np.int64)
        parts = [answers[b] for b in sorted(answers)]
        ids[order] = np.concatenate([p["ids"] for p in parts])
        n[order] = np.concatenate([p["n"] for p in parts]).astype(np.int64)
        ids[n == 0] = UNKNOWN_ID
        tokens = data["tokens"].astype(np.int64)
        self.word, self.count = ids[tokens], n[tokens]
        self.words, an_own, rank = np.unique(ids, return_index=True, return_inverse=True)
        self.word_rank = rank[tokens]
        #: The distinct n-grams of the order that was laid out last in the order of their ids, each token's place among
        #: them, and their counts.
        self.grams, self.gram_rank, self.gram_n = [self.words], self.word_rank, n[an_own]
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        self.unigrams, self.buckets = unigrams, buckets
        #: Of the order that was taken in last: how often each token's n-gram stands in training, what its
        #: history's counts are divided by (training blocks), its probability (held-out blocks).
        self.gram_count, self.divisor = self.count, np.full(len(tokens), unigrams.divisor)
        self.p = unigrams.p(n)[tokens] if self.test else np.zeros(0)

    def lay_out(self) -> None:
        """The next order's distinct n-grams to ask for, by bucket and sorted, and which of them each token in ``known`` is."""
        c_h = np.empty_like(self.gram_count)
        c_h[1:] = self.gram_count[:-1]
        c_h[self.first] = self.unigrams.documents
        known = np.flatnonzero(c_h > 0)  # else the shorter history's probability stays
        # A history is the n-gram before the token; what begins a document comes before all others.
        history = np.empty_like(self.gram_rank)
        history[1:] = self.gram_rank[:-1] + 1
        history[self.first] = 0
        keys, self.known = sorted_pairs(history[known], self.word_rank[known].view(np.uint64), known, len(self.grams[0]), len(self.words))
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
        self.sorted_times = np.diff(starts, append=len(keys))
        width = np.uint64(len(self.words).bit_length())
        word, history = self.words[keys[starts] & ((np.uint64(1) << width) - np.uint64(1))], (keys[starts] >> width).astype(np.int64)
        heads = np.flatnonzero(np.diff(history, prepend=-1))
        lengths, head = np.diff(heads, append=len(history)), history[heads]
        of_history = [np.concatenate((np.full(1, BEGIN_ID, np.uint64), c))[head] for c in self.grams]
        key, c_h = joined(of_history), np.concatenate(([self.unigrams.documents], self.gram_n))[head]
        bucket = np.repeat(_bucket_of(mixed(key, np.zeros_like(key)), self.buckets), lengths)
        columns, key, c_h = [np.repeat(h, lengths) for h in of_history], np.repeat(key, lengths), np.repeat(c_h, lengths)
        hot = np.flatnonzero(c_h > HOT)
        salts = (-(-c_h[hot] // HOT)).astype(np.uint64)
        bucket[hot] = _bucket_of(mixed(key[hot], mixed(word[hot], np.ones_like(salts)) % salts), self.buckets)
        by = _sorting(bucket, self.buckets)
        self.place = np.empty_like(by)
        self.place[by] = np.arange(len(by))
        self.grams = [*columns, word]
        self.gram_rank = np.zeros_like(self.gram_rank)
        self.gram_rank[self.known] = np.repeat(np.arange(len(starts)), self.sorted_times)
        self.history, self.asked_word, self.bucket = [c[by] for c in columns], word[by], bucket[by]
        self.pairs, self.c_h, self.times, history = self.known[starts][by], c_h[by], self.sorted_times[by], history[by]
        self.run_opens = np.ones(len(by), bool)
        self.run_opens[1:] = (self.bucket[1:] != self.bucket[:-1]) | (history[1:] != history[:-1])

    def of_known(self, values: np.ndarray) -> np.ndarray:
        """For each token in ``known`` the value of its n-gram."""
        return np.repeat(values[self.place], self.sorted_times)

    def questions(self, block: int, order: int, part: int, parts: int) -> list[tuple[int, int, str, bytes]]:
        """To the buckets of one of the ``parts`` of all buckets."""
        out = []
        for b, x, y in _runs(self.bucket):
            if b % parts != part:
                continue
            opens = np.flatnonzero(self.run_opens[x:y])
            own = {f"h{i}": h[x:y][opens] for i, h in enumerate(self.history, 1)}
            own["h1"] = np.diff(own["h1"], prepend=np.uint64(0))  # sorted
            own |= {"lengths": np.diff(np.append(opens, y - x)).astype(np.uint64), "hot": self.c_h[x:y][opens] > HOT, "word": self.asked_word[x:y]}
            if not self.test:
                lower = self.pairs[x:y]
                own |= {"n": self.times[x:y].astype(np.uint64), "lower_n": self.gram_count[lower].astype(np.uint64)}
                if order > 2:
                    own["lower_divisor"] = self.divisor[lower[opens]].astype(np.uint64)
            out.append((b, block, "ask-held-out" if self.test else "ask", pack_arrays(**own)))
        return out

    def answered(self, answers: dict[int, dict[str, np.ndarray]], hot: dict[str, np.ndarray], discounts: Discounts) -> None:
        """Take in the next order's answers."""
        n, divisors = np.zeros(0, np.int64), np.zeros(0)
        p = np.zeros(0)
        if len(self.pairs):
            own = [answers[b] for b in sorted(answers)]
            n = np.concatenate([a["n"] for a in own]).astype(np.int64)
            names = HISTORY_SUMS if self.test else ("mask",)
            sums = {k: np.concatenate([a[k] for a in own]).astype(np.float64 if self.test else np.uint8) for k in names}
            c_h = self.c_h[self.run_opens].astype(np.float64)
            is_hot = np.flatnonzero(c_h > HOT)
            if len(is_hot):
                place = np.searchsorted(hot["history"], joined([h[self.run_opens][is_hot] for h in self.history]))
                for k in names:
                    sums[k][is_hot] = (_mask(hot) if k == "mask" else hot[k])[place]
            run_of = np.cumsum(self.run_opens) - 1
            if self.test:
                divisor, alpha = history_weights(c_h, np.array([sums[f"seen{r}"] for r in range(1, GT_MAX + 1)]), sums["many"], sums["lower"], discounts)
                p = np.where(n > 0, discounts.discounted(n) / divisor[run_of], alpha[run_of] * self.p[self.pairs])
            else:
                divisors = (c_h + ((sums["mask"] & _losing(discounts)) == 0))[run_of]
        count = np.zeros_like(self.gram_count)
        count[self.known] = self.of_known(n)
        self.gram_count, self.gram_n = count, n[self.place]
        if self.test:
            self.p = self.p.copy()
            self.p[self.known] = self.of_known(p)
        else:
            self.divisor = np.empty(len(count))
            self.divisor[self.known] = self.of_known(divisors)

    def probabilities(self, discounts: Discounts) -> np.ndarray:
        """Of the highest order that was taken in; in training blocks every n-gram is seen."""
        return self.p if self.test else discounts.discounted(self.gram_count) / self.divisor


def _mask(sums: dict[str, np.ndarray]) -> np.ndarray:
    """Which counts up to GT_MAX a history has, as bits."""
    return sum((sums[f"seen{r}"] > 0).astype(np.uint8) << (r - 1) for r in range(1, GT_MAX + 1)).astype(np.uint8)


def _losing(discounts: Discounts) -> np.uint8:
    return np.uint8(sum(1 << (r - 1) for r in range(1, GT_MAX + 1) if discounts.loses[r]))


def _count_ngrams(order: int, unigrams: Unigrams, discounts: dict[int, Discounts]):
    def run(group: pa.Table) -> pa.Table:
        return _counted_bucket(group, order, unigrams, discounts.get(order - 1))

    return run


def _counted_bucket(group: pa.Table, order: int, unigrams: Unigrams, shorter: Discounts | None) -> pa.Table:
    """Add up a bucket's n-grams and answer each block in the order it asked."""
    asked = [(row["block"], row["kind"] == "ask", unpack_arrays(row["payload"])) for row in group.to_pylist()]
    bucket = group.column("bucket")[0].as_py()
    names = [f"h{i}" for i in range(1, order)]
    for _, _, a in asked:
        a["h1"] = np.cumsum(a["h1"], dtype=np.uint64)
    history = [np.concatenate([np.repeat(a[k], a["lengths"].astype(np.int64)) for _, _, a in asked]) for k in names]
    word = np.concatenate([a["word"] for _, _, a in asked])

    def of_training(values) -> np.ndarray:
        return np.concatenate([values(a) if trained else np.zeros(len(a["word"])) for _, trained, a in asked])

    if shorter is None:
        lower = of_training(lambda a: unigrams.p(a["lower_n"].astype(np.int64)))
    else:
        lower = of_training(lambda a: shorter.discounted(a["lower_n"].astype(np.int64)) / np.repeat(a["lower_divisor"].astype(np.float64), a["lengths"].astype(np.int64)))
    by, opens = sorted_groups([*history, word])
    starts = np.flatnonzero(opens)
    pair_of = np.empty(len(by), np.int64)
    pair_of[by] = np.cumsum(opens) - 1
    n = np.bincount(pair_of, weights=of_training(lambda a: a["n"]), minlength=len(starts)).astype(np.int64)
    lower = np.maximum.reduceat(lower[by], starts)
    at = by[starts]
    new_history = np.zeros(len(at), bool)
    new_history[:1] = True
    for column in history:
        new_history[1:] |= column[at][1:] != column[at][:-1]
    history_of = np.cumsum(new_history) - 1
    add = lambda values: np.bincount(history_of, weights=values, minlength=int(new_history.sum()))
    sums = {"many": add(np.where(n > GT_MAX, n, 0)).astype(np.uint64), "lower": add(np.where(n > 0, lower, 0.0))}
    sums |= {f"seen{r}": add(n == r).astype(np.uint64) for r in range(1, GT_MAX + 1)}
    mask = _mask(sums)
    hot = np.concatenate([np.repeat(a["hot"], a["lengths"].astype(np.int64)) for _, _, a in asked])
    is_hot = np.zeros(len(mask), bool)
    is_hot[history_of[pair_of[hot]]] = True
    heads = at[new_history]
    keys = joined([h[heads] for h in history])
    out, done = [], 0
    for block, trained, a in asked:
        own = pair_of[done : done + len(a["word"])]
        done += len(own)
        lengths = a["lengths"].astype(np.int64)
        runs = history_of[own[np.cumsum(lengths) - lengths]]
        told = {"mask": mask[runs]} if trained else {k: v[runs] for k, v in sums.items()}
        out.append((bucket, block, "answer", pack_arrays(n=n[own].astype(np.uint64), **told)))
        if is_hot[runs].any():
            out.append((bucket, block, "hot-ask", pack_arrays(history=keys[runs][is_hot[runs]])))
    if is_hot.any():
        out.append((bucket, -1, "hot", pack_arrays(history=keys[is_hot], **{k: v[is_hot] for k, v in sums.items()})))
    seen = n > 0
    kept = at[seen]
    of_kept = history_of[seen]
    opening = np.flatnonzero(np.diff(of_kept, prepend=-1))
    model = {k: h[kept][opening] for k, h in zip(names, history)}
    model["h1"] = np.diff(model["h1"], prepend=np.uint64(0))
    out.append((bucket, -1, "model", pack_arrays(**model, lengths=np.diff(np.append(opening, len(kept))).astype(np.uint64), word=word[kept], n=n[seen].astype(np.uint64))))
    out.append((bucket, -1, "sums", pack_arrays(sums=np.array([n.sum(), seen.sum(), *np.bincount(n[n <= GT_MAX + 1], minlength=GT_MAX + 2)], dtype=np.uint64))))
    return _messages(out)


def _hot_rows(kind: str):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a = unpack_arrays(row["payload"])
                columns = {"block": pa.array(np.full(len(a["history"]), row["block"]), pa.int64()), "history": pa.array(a["history"].view(np.int64))}
                if kind == "hot":
                    columns |= {k: pa.array(a[k].astype(np.float64)) for k in HISTORY_SUMS}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _pack_hot(batches):
    for batch in batches:
        for row in batch.to_pylist():
            rows = sorted(row["rows"], key=lambda r: r["history"] & 0xFFFFFFFFFFFFFFFF)
            history = np.array([r["history"] for r in rows], np.int64).view(np.uint64)
            yield from _messages([(-2, row["block"], "hot-answer", pack_arrays(history=history, **{k: np.array([r[k] for r in rows], np.float64) for k in HISTORY_SUMS}))]).to_batches()


def _hot_answers(counted: DataFrame) -> DataFrame:
    """The whole sums of salted histories, for the blocks that have them."""
    sums = ", ".join(f"{k} double" for k in HISTORY_SUMS)
    parts = counted.filter(F.col("kind") == "hot").select("block", "payload").mapInArrow(_hot_rows("hot"), f"block long, history long, {sums}")
    total = parts.groupBy("history").agg(*(F.sum(k).alias(k) for k in HISTORY_SUMS))
    wanted = counted.filter(F.col("kind") == "hot-ask").select("block", "payload").mapInArrow(_hot_rows("ask"), "block long, history long").distinct()
    by_block = wanted.join(total, "history").groupBy("block").agg(F.collect_list(F.struct("history", *HISTORY_SUMS)).alias("rows"))
    return by_block.mapInArrow(_pack_hot, MESSAGE)


# ---------------------------------------------------------------- the model


def _block_of(group: pa.Table, buckets: int, unigrams: Unigrams, discounts: dict[int, Discounts]) -> tuple[int, Block]:
    """A block with the answers of all orders so far taken in."""
    rows = group.to_pylist()
    kinds: dict[str, dict[int, dict[str, np.ndarray]]] = {}
    for row in rows:
        if row["kind"] == "file":
            uri = row["payload"].decode()
        else:
            kinds.setdefault(row["kind"], {})[row["bucket"]] = unpack_arrays(row["payload"])
    block = Block(uri, kinds["answer1"], buckets, unigrams)
    for order in sorted(discounts):
        block.lay_out()
        hot = kinds.get(f"hot-answer{order}", {}).get(-2, {})
        block.answered(kinds.get(f"answer{order}", {}), hot, discounts[order])
    return rows[0]["block"], block


def _ask_ngrams(order: int, buckets: int, unigrams: Unigrams, discounts: dict[int, Discounts], part: int, parts: int):
    def run(group: pa.Table) -> pa.Table:
        number, block = _block_of(group, buckets, unigrams, discounts)
        block.lay_out()
        return _messages(block.questions(number, order, part, parts))

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int, unigrams: Unigrams, discounts: dict[int, Discounts]):
    def run(group: pa.Table) -> pa.Table:
        _, block = _block_of(group, buckets, unigrams, discounts)
        base = np.log10((block.count + 1) / (unigrams.total + unigrams.distinct + 1))
        add = lambda values: np.add.reduceat(values, block.first)
        p = block.probabilities(discounts[max(discounts)] if discounts else unigrams.discounts)
        return pa.table({
            "doc_id": pa.array(block.doc_ids, mask=block.null_ids), "held_out": pa.array(np.full(len(block.first), block.test)), "n_tokens": pa.array(block.n_tokens), "n_known": pa.array(add((block.count > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(block.first), unigrams.total, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(p))),
        })

    return run


@dataclass
class KatzModel:
    """``counted``: for each order the table, partitioned by kind, whose ``model`` rows hold its counts."""

    manifest: DataFrame
    counted: dict[int, DataFrame]
    unigrams: Unigrams
    discounts: dict[int, Discounts]
    buckets: int

    def counts(self, order: int) -> DataFrame:
        """(h1, ..., word, n): the counts of one order, a row for each n-gram (order 1: h1 is the word's hash)."""
        names = [f"h{i}" for i in range(1, max(order, 2))]

        def run(batches):
            for batch in batches:
                for payload in batch.column("payload").to_pylist():
                    a = unpack_arrays(payload)
                    if order > 1:
                        a["h1"] = np.cumsum(a["h1"], dtype=np.uint64)
                        a |= {k: np.repeat(a[k], a["lengths"].astype(np.int64)) for k in names}
                    yield pa.RecordBatch.from_pydict({k: pa.array(a[k].astype(np.uint64).view(np.int64)) for k in (*names, "word", "n")})

        return self.counted[order].filter(F.col("kind") == "model").select("payload").mapInArrow(run, ", ".join(f"{k} long" for k in (*names, "word", "n")))

    def weights(self, order: int) -> DataFrame:
        """(h1, ..., divisor, alpha): the weights of every history of ``order`` - 1 words, from the counts by joins."""
        history = [f"h{i}" for i in range(1, order)]
        discounts, own = self.discounts[order], self.counts(order)
        if order == 2:
            lower = self.counts(1).select("word", _discounted(self.unigrams.discounts, F.col("n"), F.lit(self.unigrams.divisor)).alias("lower"))
        else:
            shorter = [f"h{i}" for i in range(1, order - 1)]
            seen = self.counts(order - 1).join(self.weights(order - 1), shorter).select(*shorter, "word", _discounted(self.discounts[order - 1], F.col("n"), F.col("divisor")).alias("lower"))
            lower = seen.select(*(F.col(f"h{i}").alias(f"h{i + 1}") for i in range(1, order - 1)), "word", "lower")
        loses = [r for r in range(1, GT_MAX + 1) if discounts.loses[r]]
        summed = own.join(lower, [c for c in lower.columns if c != "lower"]).groupBy(*history).agg(
            F.sum("n").alias("c_h"), F.sum("lower").alias("lower"), F.sum(_discounted(discounts, F.col("n"), F.lit(1.0))).alias("kept"), F.bool_or(F.col("n").isin(loses) if loses else F.lit(False)).alias("loses")
        )
        divisor = F.col("c_h") + F.when(F.col("loses"), 0).otherwise(1)
        return summed.select(*history, divisor.cast("double").alias("divisor"), ((1 - F.col("kept") / divisor) / F.greatest(1 - F.col("lower"), F.lit(1e-12))).alias("alpha"))

    def scores(self) -> DataFrame:
        """Per document of the corpus: SCORES."""
        return _to_blocks(self.manifest, self.counted).groupBy("block").applyInArrow(_score(self.buckets, self.unigrams, self.discounts), SCORES)


def _discounted(discounts: Discounts, n: Column, divisor: Column) -> Column:
    factor = F.element_at(F.array(*(F.lit(float(x)) for x in discounts.d[1:])), F.least(n, F.lit(GT_MAX)).cast("int"))
    return F.when(n > GT_MAX, n).otherwise(factor * n) / divisor


def _to_blocks(manifest: DataFrame, counted: dict[int, DataFrame]) -> DataFrame:
    """Everything that blocks are told: their file and the answers of all orders."""
    told = manifest.select(F.lit(-1).cast("long").alias("bucket"), "block", F.lit("file").alias("kind"), F.col("uri").cast("binary").alias("payload"))
    for order, table_of in counted.items():
        answers = table_of.filter(F.col("kind") == "answer").select("bucket", "block", "kind", "payload")
        if order > 1:
            answers = answers.union(_hot_answers(table_of))
        told = told.union(answers.withColumn("kind", F.concat("kind", F.lit(str(order)))))
    return told


def train(docs: DataFrame, order: int = ORDER) -> KatzModel:
    """Count the training documents (doc_id, text) and keep what scoring all of them needs."""
    spark = docs.sparkSession
    folder = with_scheme(spark, new_path(spark, "token-blocks"))
    doc_id = F.col("doc_id").cast("long")
    source = docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("test"))
    manifest = materialize(source.mapInArrow(_make_blocks(folder), "block long, uri string, documents long, tokens long"), "blocks")
    n_blocks, documents, tokens = manifest.agg(F.count("*"), F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    buckets = max(8, -(-tokens // BLOCK_TOKENS))
    asked = manifest.select("block", "uri").repartitionByRange(max(1, n_blocks), "block").mapInArrow(_ask_words(buckets), MESSAGE)
    counted = {1: materialize(asked.groupBy("bucket").applyInArrow(_count_words(buckets), MESSAGE), "ngrams-1", ["kind"])}
    total, distinct, *counts_of_counts = _sums(counted[1])
    unigrams, discounts = Unigrams.of(total, distinct, documents, counts_of_counts), {}
    for n in range(2, order + 1):
        done, own = dict(counted), []
        parts = PARTS if n > 2 else 1
        for part in range(parts):  # the questions of one part are on disk at a time
            asked = _to_blocks(manifest, done).groupBy("block").applyInArrow(_ask_ngrams(n, buckets, unigrams, dict(discounts), part, parts), MESSAGE)
            own.append(materialize(asked.groupBy("bucket").applyInArrow(_count_ngrams(n, unigrams, dict(discounts)), MESSAGE), f"ngrams-{n}", ["kind"]))
        counted[n] = reduce(DataFrame.union, own)
        discounts[n] = Discounts.of(_sums(counted[n])[2:])
    return KatzModel(manifest, counted, unigrams, discounts, buckets)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train(table(spark, sf_dir, "documents")).scores()

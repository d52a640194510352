"""Toxicity: a bag of subword embeddings averaged into a linear softmax.

A word stands for itself and its character n-grams (with word borders), each hashed to one of
``BUCKETS`` embeddings; a document is the average over the features of all its distinct words, and a
linear softmax on that average gives the two classes.  Features are hashed for many words at once,
as differences of running sums over their code points.  A word counts once in a document, so
long texts don't drown a rare word.  Embeddings and softmax are trained together in numpy, on
a bounded sample of labelled documents, by full-batch gradient steps whose length is set by the
largest entry of the whole embedding gradient: what many documents share moves first, and what
only one document has hardly moves.  Unseen misspellings share n-grams with what was seen.

Once trained, a word's part in the logit is a single number, so whole texts are scored by
summing numbers of distinct words.

Defined cases: null and empty texts have no features and get the softmax of the bias; without
any usable label every score is the share of class 1 (0.5 if unknown); repeated rows are
scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexmill.llm.common import table
from lexmill.llm.labelled import held_out, labelled_sample
from lexmill.llm.words import give_back, numbered_words, slices_of, whole_texts

BUCKETS, DIMENSIONS, SHORTEST, LONGEST = 1 << 17, 4, 3, 6
PER_CLASS, MAX_CHARS = (2000, 1000), 16_000_000
STEPS, RATE, SOFTMAX_RATE, MOMENTUM = 150, 1.0, 0.05, 0.8
THRESHOLD = 0.5
SLICE_BYTES, WORDS_AT_ONCE = 2_000_000, 32_768
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"
#: An odd number and its inverse modulo 2**64, for hashes of substrings.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the features of distinct words: each word (with its borders) and its n-grams."""
    edge = [pa.scalar(x, pa.large_string()) for x in ("<", ">", "")]
    marked = pc.binary_join_element_wise(edge[0], pc.utf8_trim(pc.utf8_lower(whole_texts(words)), EDGES), *edge[1:])
    lengths = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    powers = np.cumprod(np.full(len(codes), _BASE, np.uint64))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((codes + np.uint64(1)) * powers)))
    shift_back = np.cumprod(np.full(len(codes), _INVERSE, np.uint64))
    ends = np.cumsum(lengths)
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))

    def buckets(first: np.ndarray, last: np.ndarray, kind: int) -> np.ndarray:
        x = (sums[last] - sums[first]) * shift_back[first] + np.uint64(kind)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) >> np.uint64(8)).astype(np.int64) % BUCKETS

    own, found = [np.arange(len(words), dtype=np.int32)], [buckets(ends - lengths, ends, 0).astype(np.int32)]
    for n in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero(left >= n)
        own.append(word_of[at])
        found.append(buckets(at, at + n, n).astype(np.int32))
    return np.concatenate(own), np.concatenate(found)


def _distinct(numbers: np.ndarray, counts: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of the distinct words of each text."""
    pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * max(1, n_words) + numbers)
    return pairs // max(1, n_words), pairs % max(1, n_words)


def distinct_words(texts: pa.Array) -> pa.ListArray:
    """The distinct words of each text."""
    numbers, words, counts = numbered_words(texts, lower=True)
    text_of, word = _distinct(numbers, counts, len(words))
    offsets = np.searchsorted(text_of, np.arange(len(counts) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(word)).cast(pa.string()))


@dataclass
class Model:
    """``per_bucket``: what a feature adds to the difference of the logits before averaging."""

    per_bucket: np.ndarray
    bias: float


def _softmax_difference(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -50, 50)))


def train(bags: pa.ListArray, y: np.ndarray, share: float, seed: int = 0) -> Model:
    """Fit embeddings and softmax together to documents' distinct words; ``share`` (of class 1) is
    what is left to say without both classes."""
    if not len(y) or len(set(y.tolist())) < 2:
        p = np.clip(share if not len(y) else float(np.mean(y)), 1e-3, 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    counts = pc.list_value_length(bags).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = bags.flatten().dictionary_encode()
    text_of, word = np.repeat(np.arange(len(y)), counts), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = len(encoded.dictionary)
    own, bucket = word_features(encoded.dictionary)
    used, column = np.unique(bucket, return_inverse=True)
    per_word = np.bincount(own, minlength=n_words)
    per_text = np.maximum(np.bincount(text_of, weights=per_word[word], minlength=len(y)), 1)
    # Features by word, and words by feature, each with the places where a run begins.
    by_word = column[np.argsort(own, kind="stable")]
    by_column = own[np.argsort(column, kind="stable")].astype(np.int64)
    word_start = np.cumsum(per_word) - per_word
    column_start = np.cumsum(np.bincount(column, minlength=len(used)))[:-1]
    column_start = np.concatenate(([0], column_start))[: len(used)]
    del own, bucket, column
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.01, (DIMENSIONS, len(used))).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    # Each class counts as half.
    importance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32)
    parameters = [embedding, softmax, bias]
    momenta = [np.zeros_like(p) for p in parameters]
    sides = np.array([-1, 1], np.float32)
    for _ in range(STEPS if len(used) else 0):
        # With two classes the errors of a document are -e and e, so all of the gradient follows from
        # one pass from features to words to documents, and one back.
        direction = softmax @ sides
        of_words = np.add.reduceat((direction @ embedding)[by_word], word_start)
        logit = np.bincount(text_of, weights=of_words[word], minlength=len(y)) / per_text + bias @ sides
        error = (_softmax_difference(logit) - y) * importance
        to_words = np.bincount(word, weights=(error / per_text)[text_of], minlength=n_words).astype(np.float32)
        to_features = np.add.reduceat(to_words[by_column], column_start)
        gradients = [np.outer(direction, to_features), np.outer(embedding @ to_features, sides), error.sum() * sides]
        for parameter, gradient, momentum in zip(parameters, gradients, momenta):
            momentum += (1 - MOMENTUM) * (gradient - momentum)
            largest = float(np.abs(momentum).max()) + 1e-12
            parameter -= (RATE if parameter is embedding else SOFTMAX_RATE * min(1.0, largest / 0.02)) / largest * momentum
    per_bucket = np.zeros(BUCKETS, np.float32)
    per_bucket[used] = (softmax[:, 1] - softmax[:, 0]) @ embedding
    return Model(per_bucket, float(bias[1] - bias[0]))


class Scorer:
    """Scores texts some megabytes at a time; a distinct word's features are added up once for each such slice."""

    def __init__(self, model: Model) -> None:
        self._model = model

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = []
        for first, last in slices_of(texts, SLICE_BYTES):
            numbers, words, counts = numbered_words(texts.slice(first, last - first), lower=True)
            added, features = np.zeros(len(words)), np.zeros(len(words))
            for at in range(0, len(words), WORDS_AT_ONCE):
                part = words.slice(at, WORDS_AT_ONCE)
                own, bucket = word_features(part)
                added[at : at + len(part)] = np.bincount(own, weights=self._model.per_bucket[bucket], minlength=len(part))
                features[at : at + len(part)] = np.bincount(own, minlength=len(part))
            text_of, word = _distinct(numbers, counts, len(words))
            total = np.bincount(text_of, weights=added[word], minlength=len(counts))
            n = np.bincount(text_of, weights=features[word], minlength=len(counts))
            out.append(_softmax_difference(total / np.maximum(n, 1) + self._model.bias))
        return np.concatenate(out) if out else np.zeros(0)


def _bags(batches):
    for batch in batches:
        for first, last in slices_of(batch.column("text"), SLICE_BYTES):
            yield pa.RecordBatch.from_pydict({"words": distinct_words(batch.column("text").slice(first, last - first)), "y": batch.column("y").slice(first, last - first)})


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """Train on at most ``per_class`` labelled documents of classes 0 and 1 (whole texts), ``max_chars`` in all."""
    sample, share = labelled_sample(docs, labels, "toxic", per_class, max_chars)
    rows = sample.select("text", "y").mapInArrow(_bags, "words array<string>, y int").toArrow()
    bags = rows.column("words").combine_chunks()
    return train(bags, rows.column("y").to_numpy().astype(np.int64), share)


def scored(model: Model, text: Column) -> Column:
    """The score of a column of texts, 0 to 1."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(model)  # BUCKETS numbers, whatever the tables' size
    kept: dict[str, Scorer] = {}

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if "scorer" not in kept:
            kept["scorer"] = Scorer(held.value)
        scores = pa.array(kept["scorer"](texts))
        give_back()
        return scores

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(fit(docs, labels), F.col("text")).alias("score"))
    return own.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all their columns) that are not predicted toxic."""
    return docs.filter(scored(fit(docs, labels), docs["text"]) < THRESHOLD)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

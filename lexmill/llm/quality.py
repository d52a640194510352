"""Document quality by attention-based multiple-instance learning.

(Ilse, Tomczak and Welling, "Attention-based Deep Multiple Instance Learning", 2018.)  A
document is a bag of passages of ``PASSAGE`` words, all of its text.  Every passage is encoded
(what its words look like, how they repeat, hashed character pairs); a hidden layer follows; a
gated attention, softmax over w . (tanh(V h) * sigmoid(U h)), weights the passages; a logistic
unit scores the weighted sum.  Only documents carry labels; the attention is learned from them,
with the whole network, in numpy on a bounded sample.

Defined cases: a null or empty text is a bag of one empty passage; without any usable label
every score is the share of class 1 (0.5 if unknown); repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexmill.llm.common import table
from lexmill.llm.labelled import held_out, labelled_sample
from lexmill.llm.words import give_back, numbered_words, slices_of, whole_texts

PASSAGE = 48
SHAPE, HASHED = 9, 8
ENCODED = SHAPE + HASHED + 4
HIDDEN, GATE = 16, 8
PER_CLASS, MAX_CHARS = (1500, 1500), 32_000_000
STEPS, RATE, DECAY = 150, 0.03, 1e-3
THRESHOLD = 0.3
SLICE_BYTES, WORDS_AT_ONCE = 2_000_000, 32_768


@cache
def _kinds() -> np.ndarray:
    """What each code point is: 1 a letter, 2 a digit, 4 upper case."""
    every = [chr(c) for c in range(0x110000)]
    kinds = [np.fromiter(map(test, every), bool, len(every)) for test in (str.isalpha, str.isdigit, str.isupper)]
    return (kinds[0] | kinds[1] << 1 | kinds[2] << 2).astype(np.uint8)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, the length of each)."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def word_shapes(words: pa.Array) -> np.ndarray:
    """What words (none of them empty) look like, a row for each; nothing in it depends on a language."""
    codes, n = _codes(words)
    starts, kinds = np.cumsum(n) - n, _kinds()[codes]
    letters, digits = (np.add.reduceat((kinds & k) > 0, starts, dtype=np.int64) for k in (1, 2))
    odd = n - letters - digits
    tail = n - pc.utf8_length(pc.utf8_rtrim(words, "!?.,;:*#$%&|-_=~")).to_numpy(zero_copy_only=False)
    upper = pc.utf8_is_upper(words).to_numpy(zero_copy_only=False)
    out = np.zeros((len(words), SHAPE + HASHED), np.float32)
    shape = [(letters > 1) & upper, (kinds[starts] & 4) > 0, letters / n, digits / n, odd / n, odd == n, tail > 1, np.minimum(n, 40) / 10, odd > tail]
    out[:, :SHAPE] = np.stack(shape, axis=1)
    bare, lengths = _codes(pc.utf8_lower(words))
    word = np.repeat(np.arange(len(words)), lengths)
    paired = word[1:] == word[:-1]
    place = (bare[:-1].astype(np.int64) * 31 + bare[1:]) % HASHED
    pairs = np.bincount(word[1:][paired] * HASHED + place[paired], minlength=len(words) * HASHED).reshape(-1, HASHED)
    out[:, SHAPE:] = pairs / n[:, None]
    return out


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages x ENCODED, the number of passages of each text, at least one)."""
    numbers, words, counts = numbered_words(texts, lower=False)
    table = np.zeros((len(words), SHAPE + HASHED), np.float32)
    for at in range(0, len(words), WORDS_AT_ONCE):
        part = whole_texts(words.slice(at, WORDS_AT_ONCE))
        table[at : at + len(part)] = word_shapes(part)
    passages = np.maximum(-(-counts // PASSAGE), 1)
    out = np.zeros((int(passages.sum()), ENCODED), np.float32)
    if len(numbers):
        within = np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts)
        passage = np.repeat(np.cumsum(passages) - passages, counts) + within // PASSAGE
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        filled, n = passage[starts], np.diff(np.append(starts, len(numbers)))
        for d in range(SHAPE + HASHED):
            out[filled, d] = np.add.reduceat(table[:, d][numbers], starts) / n
        again = np.concatenate(([False], (numbers[1:] == numbers[:-1]) & (passage[1:] == passage[:-1])))
        distinct = np.bincount(np.unique(passage * len(words) + numbers) // len(words), minlength=len(out))
        out[filled, -4] = np.add.reduceat(again.astype(np.float32), starts) / n
        out[filled, -3] = distinct[filled] / n
        out[filled, -2] = np.log1p(n)
    out[:, -1] = np.repeat(np.log1p(counts), passages)
    return out, passages


@dataclass
class Model:
    """Weights of the network; without any (``layers`` empty) every score is ``prior``."""

    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]
    prior: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _forward(x: np.ndarray, sizes: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    starts = np.cumsum(sizes) - sizes
    h = np.tanh(x @ p["encode"] + p["encode_bias"])
    t, g = np.tanh(h @ p["attend"]), _sigmoid(h @ p["gate"])
    a = (t * g) @ p["weigh"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
    a /= np.repeat(np.add.reduceat(a, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["out"] + p["out_bias"]), "starts": starts}


def initial_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    return {"encode": normal(ENCODED, HIDDEN), "encode_bias": np.zeros(HIDDEN, np.float32), "attend": normal(HIDDEN, GATE), "gate": normal(HIDDEN, GATE), "weigh": normal(GATE), "out": normal(HIDDEN), "out_bias": np.zeros((), np.float32)}


def gradients(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, importance: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy, by every weight."""
    f = _forward(x, sizes, p)
    error = (f["score"] - y) * importance
    to_z = np.repeat(error[:, None] * p["out"], sizes, axis=0)
    to_a = (to_z * f["h"]).sum(axis=1)
    to_logit = f["a"] * (to_a - np.repeat(np.add.reduceat(f["a"] * to_a, f["starts"]), sizes))
    to_gated = to_logit[:, None] * p["weigh"]
    to_t, to_g = to_gated * f["g"] * (1 - f["t"] ** 2), to_gated * f["t"] * f["g"] * (1 - f["g"])
    to_h = (f["a"][:, None] * to_z + to_t @ p["attend"].T + to_g @ p["gate"].T) * (1 - f["h"] ** 2)
    return {
        "encode": x.T @ to_h, "encode_bias": to_h.sum(axis=0), "attend": f["h"].T @ to_t, "gate": f["h"].T @ to_g,
        "weigh": to_logit @ (f["t"] * f["g"]), "out": error @ f["z"], "out_bias": error.sum(),
    }


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, share: float, seed: int = 0) -> Model:
    """Fit the network to bags of ``sizes`` passages; both classes weigh the same."""
    if not len(y) or len(set(y.tolist())) < 2:
        return Model(np.zeros(ENCODED), np.ones(ENCODED), {}, share if not len(y) else float(y[0]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    p = initial_weights(np.random.default_rng(seed))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    importance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32)
    for step in range(1, STEPS + 1):
        for name, gradient in gradients(x, sizes, y, importance, p).items():
            gradient = gradient + DECAY * p[name]
            first, second = moments[name]
            first = first + 0.1 * (gradient - first)
            second = second + 0.01 * (gradient**2 - second)
            moments[name] = (first, second)
            p[name] = (p[name] - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, p, share)


class Scorer:
    def __init__(self, model: Model) -> None:
        self._model = model

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not self._model.layers:
            return np.full(len(texts), self._model.prior)
        out = []
        for first, last in slices_of(texts, SLICE_BYTES):
            x, sizes = encoded(texts.slice(first, last - first))
            x = ((x - self._model.mean) / self._model.scale).astype(np.float32)
            out.append(_forward(x, sizes, self._model.layers)["score"].astype(np.float64))
        return np.concatenate(out) if out else np.zeros(0)


def _bags(batches):
    for batch in batches:
        for first, last in slices_of(batch.column("text"), SLICE_BYTES):
            x, sizes = encoded(batch.column("text").slice(first, last - first))
            cuts = np.cumsum(sizes)
            parts = [x[b - n : b].tobytes() for b, n in zip(cuts.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_pydict({"passages": pa.array(parts, pa.binary()), "y": batch.column("y").slice(first, last - first)})


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """Train on at most ``per_class`` labelled documents of classes 0 and 1 (whole texts), ``max_chars`` in all."""
    sample, share = labelled_sample(docs, labels, "quality", per_class, max_chars)
    rows = sample.select("text", "y").mapInArrow(_bags, "passages binary, y int").collect()
    bags = [np.frombuffer(r.passages, np.float32).reshape(-1, ENCODED) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, ENCODED), np.float32)
    return train(x, np.array([len(b) for b in bags], dtype=np.int64), np.array([r.y for r in rows], dtype=np.int64), share)


def scored(model: Model, text: Column) -> Column:
    """The score of a column of texts, 0 to 1."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(model)  # some hundred numbers
    kept: dict[str, Scorer] = {}

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if "scorer" not in kept:
            kept["scorer"] = Scorer(held.value)
        scores = pa.array(kept["scorer"](texts))
        give_back()
        return scores

    return score(text)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(fit(docs, labels), F.col("text")).alias("score"))
    return own.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all their columns) whose quality is predicted good."""
    return docs.filter(scored(fit(docs, labels), docs["text"]) >= THRESHOLD)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

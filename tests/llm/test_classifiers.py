from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import labelled, quality, toxicity
from lexmill.llm.words import numbered_words

SF = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


@pytest.mark.parametrize(("op", "label", "least"), [(quality.op8, "quality", 0.95), (toxicity.op5, "toxic", 0.7)])
def test_held_out_rows(spark, op, label, least):
    scored = op(spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert auc(np.array([r.score for r in held]), np.array([r[label] for r in held])) > least


def test_unseen_misspellings_share_n_grams():
    rng = np.random.default_rng(0)
    plain = [" ".join(f"w{n}" for n in rng.integers(0, 80, 40)) for _ in range(200)]
    insults = ["grumblesnark", "grumblesnarks", "xgrumblesnark"]
    texts = [t + (" " + insults[i % 3] if i % 2 else "") for i, t in enumerate(plain)]
    y = np.array([i % 2 for i in range(200)])
    scorer = toxicity.Scorer(toxicity.train(toxicity.distinct_words(pa.array(texts)), y, 0.5))
    clean, odd = scorer(pa.array([plain[0], plain[0] + " grumblesn4rk", None, ""]))[:2]
    assert odd > 0.5 > clean


def test_attention_finds_the_one_bad_passage():
    rng = np.random.default_rng(1)
    good = lambda n: " ".join("abcdefg"[: k + 2] + "n" for k in rng.integers(0, 5, n))
    texts = [good(200) + (" ###" * 50 if i % 2 else "") + " " + good(150) for i in range(120)]
    x, sizes = quality.encoded(pa.array(texts))
    model = quality.train(x, sizes, np.array([1 - i % 2 for i in range(120)]), 0.5)
    a, b = quality.Scorer(model)(pa.array([good(300), good(300) + " ###" * 50 + " " + good(60)]))
    assert a > 0.5 > b


def test_edges(spark, documents, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 0, None), (None, 1, 1), (5, 0, 1), (8, 1, 0), (6, 7, 9)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for found in (quality.quality(documents, labels), toxicity.toxicity(documents, labels)):
            rows = found.collect()
            assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(empty, some).count() == toxicity.toxicity(empty, some).count() == 0
    assert quality.good_documents(documents, none).columns == toxicity.without_toxic(documents, none).columns == documents.columns


def test_sliced_texts():
    texts = pa.array([None, "Ünd Ä", "ABC dÉ", "x"] * 50)
    numbers, words, counts = numbered_words(texts.slice(5, 150), lower=True)
    expected = ["".join(c.lower() if c.isascii() else c for c in w) for t in texts.slice(5, 150).to_pylist() for w in (t or "").split(" ") if w]
    assert [words[i].as_py() for i in numbers.tolist()] == expected and counts.sum() == len(expected)


def test_labels_of_missing_documents_take_no_place(spark):
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    usable = [r.doc_id for r in labels.filter(~labelled.held_out(F.col("doc_id"))).collect()]
    toxic = sorted(i for i in usable if i % 2 == 1)[-25:]
    docs = spark.createDataFrame([(i, "x") for i in toxic + [i for i in range(400) if i % 2 == 0]], "doc_id long, text string")
    sample, share = labelled.labelled_sample(docs, labels, "toxic", (10, 20), 1000)
    counts = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    clean = sum(1 for i in usable if i % 2 == 0)
    assert counts == {0: 10, 1: 20} and share == 25 / (25 + clean)


def test_sample_is_bounded_in_characters_and_takes_an_id_once(spark):
    labels = spark.range(100).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    docs = spark.createDataFrame([(i, c * 100) for i in range(100) for c in "ab"], "doc_id long, text string")
    sample, _ = labelled.labelled_sample(docs, labels, "toxic", (30, 30), 1000)
    rows = sample.collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 10 and sum(r.y for r in rows) == 5


def test_word_features_by_plain_substrings():
    words = ["Fox.", "é", "", "grüße!", "fox", "<>", "x" * 300]
    own, bucket = toxicity.word_features(pa.array(words))
    features = [np.sort(bucket[own == i]).tolist() for i in range(len(words))]
    for word, found in zip(words, features):
        whole = f"<{word.lower().strip(toxicity.EDGES)}>"
        assert len(found) == 1 + sum(max(0, len(whole) - n + 1) for n in range(3, 7))
    assert features[0] == features[4] and features[2] == features[5] and features[0] != features[3]
    # "oxfox" has every n-gram of "fox>" that "fox" has: substrings hash alike wherever they stand.
    inner, _ = [set(bucket_of) for bucket_of in (toxicity.word_features(pa.array(["fox"]))[1], [])]
    assert len(inner & set(toxicity.word_features(pa.array(["oxfox"]))[1])) == 3  # fox, ox>, fox>


def test_one_step_of_the_softmax_by_plain_loops(monkeypatch):
    """Forward pass: a text's score is the softmax of the average over the features of its distinct words."""
    texts = pa.array(["b a a", "c", "a c d", "d d"])
    model = toxicity.train(toxicity.distinct_words(texts), np.array([0, 1, 0, 1]), 0.5)
    for text, score in zip(texts.to_pylist(), toxicity.Scorer(model)(texts)):
        values = [model.per_bucket[b] for w in sorted(set(text.split())) for b in toxicity.word_features(pa.array([w]))[1]]
        assert score == pytest.approx(1 / (1 + np.exp(-(sum(values) / len(values) + model.bias))))


def test_gradient_of_the_attention_by_differences():
    """One Adam step moves every weight against the sign of the numerical gradient."""
    rng = np.random.default_rng(3)
    x, sizes, y = rng.normal(size=(9, quality.ENCODED)).astype(np.float32), np.array([2, 4, 3]), np.array([0, 1, 0])
    p = {k: v.astype(np.float64) for k, v in quality.initial_weights(np.random.default_rng(0)).items()}
    importance = np.array([0.25, 0.5, 0.25])

    def loss(weights):
        score = quality._forward(x.astype(np.float64), sizes, weights)["score"]
        return -(importance * (y * np.log(score) + (1 - y) * np.log(1 - score))).sum()

    found = quality.gradients(x.astype(np.float64), sizes, y, importance, p)
    for name, weight in p.items():
        for at in list(np.ndindex(weight.shape))[:12] or [()]:
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert found[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6), name


def test_word_shapes_by_plain_strings():
    words = ["Word", "HTTP", "a", "1.5!!", "Straße", "ÉTÉ", "日本", "---", "x#y?", "A1"]
    for word, found in zip(words, quality.word_shapes(pa.array(words))):
        n, letters, digits = len(word), sum(map(str.isalpha, word)), sum(map(str.isdigit, word))
        odd, tail = n - letters - digits, n - len(word.rstrip("!?.,;:*#$%&|-_=~"))
        hashed = [0.0] * quality.HASHED
        for a, b in zip(word.lower(), word.lower()[1:]):
            hashed[(ord(a) * 31 + ord(b)) % quality.HASHED] += 1 / n
        shape = [letters > 1 and word.isupper(), word[0].isupper(), letters / n, digits / n, odd / n, odd == n, tail > 1, min(n, 40) / 10, odd > tail]
        assert found.tolist() == pytest.approx([*map(float, shape), *hashed]), word

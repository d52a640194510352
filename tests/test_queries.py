"""Every query of the reference's operators against its SQL in DuckDB, and scalar goldens."""

from __future__ import annotations

import math
import pathlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import evaluate, ranks, search, vectors
from lexmill.plans import code_queries, index_queries, path_queries, search_queries, text_queries
from lexmill.streaming.landing import index_landing

SF = "/root/testdata/sf0.001"
QUERIES = text_queries.QUERIES | code_queries.QUERIES | path_queries.QUERIES | search_queries.QUERIES | index_queries.QUERIES
ORACLES = text_queries.ORACLES | code_queries.ORACLES | path_queries.ORACLES | search_queries.ORACLES | index_queries.ORACLES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    own = sorted(tuple(_plain(row[c]) for c in sorted(frame.columns)) for row in frame.collect())
    answer = duck.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    other = sorted(tuple(_plain(dict(zip(columns, row))[c]) for c in sorted(columns)) for row in answer.fetchall())
    assert sorted(columns) == sorted(frame.columns) and own == other


def test_top_k_is_never_a_full_sort(spark):
    for name in ("knn_cosine_topk", "bm25_topk"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize(
    ("question", "terms"),
    [("¿Cómo se calcula el daño de un ataque crítico?", "calcula daño ataque crítico"), ("Where is the user validated?", "user validated"), ("¿Dónde está?", "")],
)
def test_text_query(spark, question, terms):
    assert spark.range(1).select(tx.text_query(F.lit(question))).first()[0] == terms


def test_fusion_arithmetic(spark):
    lists = [spark.createDataFrame([(k, i) for i, k in enumerate(keys, 1)], "id string, rank int") for keys in ("abc", "bd")]
    fused = {r.id: r.score for r in search.fuse(lists, "id").collect()}
    assert fused["b"] == pytest.approx(1 / 62 + 1 / 61) and fused["a"] == pytest.approx(1 / 61)


def test_batches_by_cost():
    lengths = [100] * 40 + [1000] * 10 + [4000] * 5
    batches = vectors.batches_by_cost(lengths, 16)
    assert sorted(i for b in batches for i in b) == list(range(55)) and max(map(len, batches)) == 16
    assert all(len(b) == 1 or len(b) * (max(lengths[i] for i in b) // 2) ** 2 <= vectors.COST_BUDGET for b in batches)


def test_the_embedder_batches_as_the_query_says(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 5000, 200))] + [(200, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked: dict = {}
    for r in vectors.batches_of_documents(docs, "id", "text").collect():
        asked.setdefault((r["room"], r["batch"]), set()).add(r["id"])
    own = vectors.batches_by_cost([len(t or "") for _, t in rows])
    assert sorted(map(sorted, own)) == sorted(map(sorted, asked.values()))


def test_exact_medians_by_ranges(spark):
    rng = np.random.default_rng(2)
    groups = {"even": rng.normal(size=300).tolist(), "odd": rng.normal(size=301).tolist(), "ties": [1.5] * 200 + [2.5] * 200, "one": [7.0], "wide": (10.0 ** rng.integers(-300, 300, 120)).tolist(), "ends": [float("-inf"), 1.0, float("inf")] * 30, "none": [None, None], None: [1.0, 2.0, 5.0, 9.0], "small": [0.0, 5e-324] * 20}
    rows = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double")
    expected = {g: float(np.median([v for v in values if v is not None])) if any(v is not None for v in values) else None for g, values in groups.items()}
    for few, buckets in ((1, 64), (10_000, 1024)):
        found = {r["g"]: (r["median"], r["n"]) for r in ranks.median(rows, ["g"], "v", few, buckets).collect()}
        assert found == {g: (m, sum(v is not None for v in groups[g])) for g, m in expected.items()}


def test_nearest_each_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS_IN_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERIES_IN_BLOCK", 3)
    rng = np.random.default_rng(0)
    own = [(f"k{i}", rng.integers(-2, 3, 4).astype(float).tolist() if i % 9 else None) for i in range(60)]
    asked = [(i, rng.normal(size=4).tolist()) for i in range(10)]
    found = vectors.nearest_each(spark.createDataFrame(own, "id string, v array<double>"), spark.createDataFrame(asked, "q long, w array<double>"), 4, "id", "v", "q", "w")
    got = {}
    for r in found.collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))
    for q, w in asked:
        all_of = sorted((round(1 - np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 12), k) for k, v in own if v and any(v))
        assert len(got[q]) == 4 and [round(1 - np.dot(dict(own)[k], w) / np.linalg.norm(dict(own)[k]) / np.linalg.norm(w), 12) for _, k in sorted(got[q])] == [d for d, _ in all_of[:4]]


def test_blocks_fill_over_batches_and_meet_by_slices_and_groups(spark, monkeypatch):
    rng = np.random.default_rng(7)
    own = [(f"k{i}", rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(600)]  # many ties
    asked = [(i, own[i][1]) for i in range(0, 600, 9)]
    rows, queries = spark.createDataFrame(own, "id string, v array<double>").coalesce(1), spark.createDataFrame(asked, "q long, w array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        pivots = vectors._pivots(rows, "id", "v")[:4]
        sizes = [r.n for r in vectors._packed(rows, "id", "v", 50, pivots).collect()]
        assert sum(sizes) == sum(any(v) for _, v in own) and max(sizes) == 50 and len(sizes) < 20
        monkeypatch.setattr(vectors, "WAITING_BYTES", 100 * 48)
        assert sum(r.n for r in vectors._packed(rows, "id", "v", 400, pivots).collect()) == sum(sizes)
        monkeypatch.setattr(vectors, "SLICE_BYTES", 5000)
        monkeypatch.setattr(vectors, "GROUP_BYTES", 1500)
        found = vectors.nearest_each(rows, queries, 3, "id", "v", "q", "w")
        got = {(r["q"], r["rank"]): r.id for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q, w in asked:
        best = sorted((round(1 - np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 12) + 0.0, k) for k, v in own if any(v) and any(w))[:3]
        assert [got.get((q, r)) for r in range(1, len(best) + 1)] == [k for _, k in best]


def test_neighbours_in_clusters_skip_most_pairs_of_blocks(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 12))
    own = [(i, (middles[i % 30] + rng.normal(scale=0.02, size=12)).tolist()) for i in range(900)]
    asked = [(i, (middles[i % 30] + rng.normal(scale=0.02, size=12)).tolist()) for i in range(60)]
    rows, queries = spark.createDataFrame(own, "id long, v array<double>"), spark.createDataFrame(asked, "q long, w array<double>")
    pivots = vectors._pivots(rows, "id", "v")
    left = vectors._packed(rows, "id", "v", 64, pivots)
    right = vectors._packed(queries, "q", "w", 64, pivots).withColumnsRenamed({"block": "query_block", "middle": "query_middle", "angle": "query_angle"})
    share = vectors.pairs_of_blocks(left, right, 5).agg({"needed": "count"}).first()[0], vectors.pairs_of_blocks(left, right, 5).filter("needed").count()
    assert 0 < share[1] < 0.4 * share[0]
    unit = lambda x: np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    distance = np.round(1 - unit([w for _, w in asked]) @ unit([v for _, v in own]).T, 12)
    expected = {(q, int(i), r + 1) for q in range(60) for r, i in enumerate(np.lexsort((np.arange(900), distance[q]))[:5])}
    assert {(r["q"], r["id"], r["rank"]) for r in vectors.nearest_each(rows, queries, 5, "id", "v", "q", "w").collect()} == expected


def test_both_hash_embedders_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = {r.doc_id: r.vector for r in vectors.hash_embedding(docs, "doc_id").collect()}
    rows = docs.collect()
    for row, vector in zip(rows, vectors.HashEmbedder().embed_documents([r.text or "" for r in rows])):
        assert own[row.doc_id] == pytest.approx(vector.tolist(), abs=1e-6)


@pytest.mark.parametrize(("word", "folded"), [("Straße", "strasse"), ("FUNCIÓN", "funcion"), ("Łódź", "lodz"), ("æØ", "aeo"), ("ế", "e"), ("Ñandú", "nandu"), ("日本", "日本"), ("İstanbul", "istanbul")])
def test_index_folding(spark, word, folded):
    assert spark.range(1).select(tx.terms(F.lit(word))).first()[0] == [folded]


def test_resumable_report_and_query_set(spark, tmp_path):
    results = spark.createDataFrame([("a", 1), ("b", 2)], "model string, n int")
    path = str(tmp_path / "report")
    assert evaluate.append_report(results.filter("model = 'a'"), path) == 1 and evaluate.append_report(results, path) == 1 and evaluate.append_report(results, path) == 0
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "q.json").write_text('[{"id": "x", "questions": {"en": "why", "es": "por qué"},\n "expected": ["a.py"]}]')
    assert sorted((r.query_id, r.lang, r.question, r.files) for r in evaluate.query_set(spark, str(tmp_path / "q.json")).collect()) == [("x", "en", "why", ["a.py"]), ("x", "es", "por qué", ["a.py"])]


def test_landing_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    docs = spark.createDataFrame([("a", "def f():\n    return 1\n", "python"), ("b", "", "text")], "file_id string, text string, language string")
    docs.write.parquet(str(landing))
    out, state = str(tmp_path / "chunks"), str(tmp_path / "state")
    for expected in (1, 1, 2):
        if expected == 2:
            docs.withColumn("file_id", F.concat("file_id", F.lit("2"))).write.mode("append").parquet(str(landing))
        assert index_landing(spark, str(landing), "file_id string, text string, language string", "file_id", out, state).awaitTermination(120)
        assert spark.read.parquet(out).count() == expected

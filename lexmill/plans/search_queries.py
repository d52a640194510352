"""Queries over vectors, full text, fusion and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import blockmax, evaluate, ranks, search
from lexmill.operators import vectors as vx
from lexmill.operators.numbering import written
from lexmill.plans.tables import literal_rows, table
from lexmill.plans.text_queries import TERMS_SQL, WORDS_SQL, folded_sql

QUERY = "the thing and thea with nicht enver, queaux de la ciónado"
FIXED_VECTOR = [round(((7 * i) % 13 - 6) / 6, 6) for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(map(str, FIXED_VECTOR)) + "]::DOUBLE[]"
_WORDS = "['thing', 'thea', 'nicht', 'enver', 'queaux', 'cionado']"


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vectors that half of them have."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(vectors, "doc_id", "left")


def _near(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(vx.nearest(table(spark, sf_dir, "embeddings"), FIXED_VECTOR, 10, "vec_id", "embedding"))


def knn_prefilter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(vx.nearest(table(spark, sf_dir, "embeddings"), FIXED_VECTOR, 10, "vec_id", "embedding", F.col("label") == 3))


def knn_all_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(vx.cosine_distance(F.col("embedding"), vx.vector_literal(FIXED_VECTOR)), 6).alias("distance"))


def knn_batch_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vx.nearest_each(rows, queries, 5, "vec_id", "embedding", "query_id", "query_vector")
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), QUERY, 20, "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"))


def bm25_prefilter_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), QUERY, 20, "doc_id", "text", F.col("lang") == "de").select("doc_id", F.round("score", 6).alias("score"))


def bm25_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_from_index(*_text_index(spark, sf_dir), QUERY, 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


#: Bytes of texts whose postings one task sorts: some 10 bytes of text make a posting of some 80 bytes in memory.
SORTED_BYTES = 24 << 20
_COUNTED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}
_INDEXES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def counted_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The written terms of a folder's documents, a row for each, and their statistics, built once in a Spark application."""
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _COUNTED:
        counted = written(search.counted_documents(table(spark, sf_dir, "documents"), "doc_id", "text", ("lang",)))
        _COUNTED[own] = counted, written(search.corpus_stats(counted.filter("dl > 0")))
    return _COUNTED[own]


def _sorted_parts(spark: SparkSession, sf_dir: str) -> int:
    size = table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, size // SORTED_BYTES)


def _text_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The written text index of a folder's documents (postings, statistics), built once in a Spark application."""
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _INDEXES:
        counted, stats = counted_index(spark, sf_dir)
        _INDEXES[own] = written(search.clustered_by_term(search.postings_of(counted, "doc_id"), _sorted_parts(spark, sf_dir))), stats
    return _INDEXES[own]


def _benchmark_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return search.bm25_each_counted(*counted_index(spark, sf_dir), queries, k, "doc_id", "item_id", "question")


def blockmax_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best German documents of every question: the filter is applied to blocks, which carry the language."""
    counted, stats = counted_index(spark, sf_dir)
    blocks = written(blockmax.blocked_documents(counted, "doc_id", ("lang",)), group_bytes=blockmax.GROUP_BYTES)
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    found = blockmax.BlockSearch(blocks, stats, queries, 3, "doc_id", "item_id", "question", F.col("lang") == "de").best()
    return found.select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark_hits(spark, sf_dir, 5).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def rank_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vx.nearest(table(spark, sf_dir, "embeddings"), FIXED_VECTOR, 50, "vec_id", "embedding")
    return search.ranked(near, "distance", "vec_id").select("vec_id", "rank")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.ranked(vx.nearest(table(spark, sf_dir, "embeddings"), FIXED_VECTOR, 50, "vec_id", "embedding"), "distance", "vec_id").select(F.col("vec_id").alias("doc_id"), "rank")
    said = search.ranked(search.bm25(table(spark, sf_dir, "documents"), QUERY, 50, "doc_id", "text"), F.desc("score"), "doc_id").select("doc_id", "rank")
    return search.fuse([near, said], "doc_id").select("doc_id", F.round("score", 9).alias("score"))


def _hybrid(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    found = search.hybrid(_scope(spark, sf_dir), FIXED_VECTOR, QUERY, key="doc_id", embedding="embedding", where=where, index=_text_index(spark, sf_dir))
    return found.select("doc_id", F.round("score", 9).alias("score"), "vector_rank", "text_rank", F.round("vector_distance", 6).alias("vector_distance"), F.round("text_score", 6).alias("text_score"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir)


def hybrid_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, F.col("source").isin("src1", "src2", "src3"))


def search_hits_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _scope(spark, sf_dir).withColumn("origin", F.lit("doc"))
    rows = search.hits(docs.select("doc_id", "origin", "text"), _hybrid(spark, sf_dir), "doc_id")
    # Scores as whole billionths, since engines print fractions in different ways.
    whole = [F.round(F.col(c) * 1e9).cast("long").alias(c) for c in ("score",)] + [F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("vector_distance", "text_score")]
    fields = F.struct("doc_id", "origin", "text", "vector_rank", "text_rank", *whole)
    return rows.select("doc_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("hit"))


def hash_embed_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(vx.hash_embedding(table(spark, sf_dir, "documents"), "doc_id", 64))
    queries = vectors.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector"))
    found = vx.nearest_each(vectors, queries, 3, "doc_id", "vector", "query_id", "query_vector")
    return found.select("query_id", "doc_id", "rank", F.round("distance", 5).alias("distance"))


# ---------------------------------------------------------------- evaluation


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ranked hits of the benchmark questions (source = file), and the expected files."""
    hits = _benchmark_hits(spark, sf_dir, 30).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    return hits.select("item_id", "source", "rank"), gold


def distinct_files_first_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.distinct_files(_judged(spark, sf_dir)[0], ["item_id"], ["source"])


def _gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, gold = _judged(spark, sf_dir)
    return evaluate.first_gold_rank(evaluate.distinct_files(hits, ["item_id"], ["source"]), gold, ["item_id"], ["source"])


def first_gold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold_ranks(spark, sf_dir)


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _gold_ranks(spark, sf_dir).select(F.lit("text").alias("mode"), F.when(F.col("item_id") % 2 == 0, "es").otherwise("en").alias("lang"), F.col("gold_rank"))
    return evaluate.hit_rates(results)


def hit_at_k_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).select("mode", "lang", "n", *(F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_5")))


def mrr_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).select("lang", F.round("mrr_10", 6).alias("mrr_10"))


def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.pivoted(_rates(spark, sf_dir), "hit_3", ["all", "en", "es"])
    return out.select("mode", *(F.round(c, 6).alias(f"hit_3_{c}") for c in ("all", "en", "es")))


def median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.median(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", F.round("median", 6).alias("median"), "n")


def resumed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = literal_rows(spark, ["('click')", "('view')", "('purchase')", "('never')"], "model")
    return evaluate.not_measured(models, table(spark, sf_dir, "events").select(F.col("event_type").alias("model")))


# ---------------------------------------------------------------- predicates


def whitelist_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "root_id")
    roots = literal_rows(spark, ["('src0')", "('src3')", "('src7')"], "root_id")
    return search.in_scope(docs, roots, ["src3", "src7", "src9"]).groupBy("root_id").agg(F.count("*").alias("n"))


def origin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("origin", F.when(F.col("doc_id") % 3 == 0, "doc").otherwise("code"))
    return docs.filter(search.origin_is("doc")).select("doc_id")


def id_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("file_id", F.substring(F.sha2("source", 256), 1, 4))
    return docs.filter(search.id_in("file_id", ["0a1b", "ffff", "5d2c"]) | (F.col("source") == "src1")).select("doc_id", "file_id")


QUERIES = {
    f.__name__: f
    for f in (
        knn_cosine_topk, knn_prefilter_label, knn_all_distances, knn_batch_per_query, bm25_topk, bm25_prefilter_lang, bm25_stored_index, bm25_multi_query, blockmax_prefilter, rank_assign, rrf_fusion, hybrid_search, hybrid_scoped, search_hits_json,
        hash_embed_knn, distinct_files_first_rank, first_gold_rank, hit_at_k_grouping_sets, mrr_at_10, report_pivot, median_latency, resumed_models, whitelist_semi_join, origin_filter, id_in_list,
    )
}

_KNN = f"SELECT vec_id, label, round(list_cosine_distance(embedding::DOUBLE[], {_VECTOR_SQL}), 6) AS distance FROM embeddings"
_KNN_RANKED = f"SELECT vec_id AS doc_id, list_cosine_distance(embedding::DOUBLE[], {_VECTOR_SQL}) AS distance FROM embeddings JOIN documents ON vec_id = doc_id"
_BM25 = f"""
d AS (SELECT doc_id, lang, source, {TERMS_SQL} AS ws FROM documents),
s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d WHERE len(ws) > 0),
h AS (SELECT doc_id, lang, source, len(ws) AS dl, term, count(*) AS tf FROM (SELECT doc_id, lang, source, ws, unnest(ws) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
w AS (SELECT doc_id, lang, source, h.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM h JOIN f USING (term), s),
b AS (SELECT doc_id, lang, source, round(sum(weight), 9) AS score FROM w WHERE list_contains({_WORDS}, term) GROUP BY ALL)"""


def _question_hits() -> str:
    from lexmill.plans.text_queries import _QUESTION_SQL

    return f"""
WITH {_BM25},
qq AS ({_QUESTION_SQL}),
q AS (SELECT DISTINCT item_id, {folded_sql('term')} AS term FROM (SELECT item_id, unnest(string_split(terms, ' ')) AS term FROM benchmark JOIN qq USING (text))),
r AS (SELECT item_id, doc_id, source, round(sum(weight), 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(weight), 9) DESC, doc_id) AS rank FROM w JOIN q USING (term) GROUP BY item_id, doc_id, source)"""


_FILES = """,
p AS (SELECT item_id, source, min(rank) AS position FROM r WHERE rank <= 30 GROUP BY ALL),
fi AS (SELECT item_id, source, position, row_number() OVER (PARTITION BY item_id ORDER BY position, source) AS rank FROM p),
g AS (SELECT b.item_id, min(fi.rank) AS gold_rank FROM benchmark b LEFT JOIN fi ON fi.item_id = b.item_id AND fi.rank <= 10 AND fi.source = 'src' || (b.item_id % 20) GROUP BY b.item_id),
m AS (SELECT 'text' AS mode, CASE WHEN item_id % 2 = 0 THEN 'es' ELSE 'en' END AS lang, gold_rank FROM g),
rates AS (SELECT mode, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n, avg(CASE WHEN gold_rank <= 1 THEN 1.0 ELSE 0.0 END) AS hit_1, avg(CASE WHEN gold_rank <= 3 THEN 1.0 ELSE 0.0 END) AS hit_3,
  avg(CASE WHEN gold_rank <= 5 THEN 1.0 ELSE 0.0 END) AS hit_5, sum(coalesce(1.0 / gold_rank, 0)) / count(*) AS mrr_10 FROM m GROUP BY GROUPING SETS ((mode, lang), (mode)))"""


def _hybrid_sql(where: str) -> str:
    return f"""
WITH {_BM25},
v AS (SELECT doc_id, distance, row_number() OVER (ORDER BY distance, doc_id) AS vector_rank FROM ({_KNN_RANKED} {where}) QUALIFY vector_rank <= 50),
t AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS text_rank FROM b {where} QUALIFY text_rank <= 50),
x AS (SELECT doc_id, coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + text_rank), 0) AS fused, vector_rank, text_rank, distance, t.score AS text_score FROM v FULL JOIN t USING (doc_id) ORDER BY fused DESC, doc_id LIMIT 8)"""


_HYBRID_COLUMNS = " SELECT doc_id, round(fused, 9) AS score, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(text_rank AS INTEGER) AS text_rank, round(distance, 6) AS vector_distance, round(text_score, 6) AS text_score FROM x"
ORACLES = {
    "knn_cosine_topk": _KNN + " ORDER BY list_cosine_distance(embedding::DOUBLE[], " + _VECTOR_SQL + "), vec_id LIMIT 10",
    "knn_prefilter_label": _KNN + " WHERE label = 3 ORDER BY list_cosine_distance(embedding::DOUBLE[], " + _VECTOR_SQL + "), vec_id LIMIT 10",
    "knn_all_distances": f"SELECT vec_id, distance FROM ({_KNN})",
    "knn_batch_per_query": """
WITH x AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 12), vec_id) AS INTEGER) AS rank, abs(round(d, 6)) AS distance FROM x QUALIFY rank <= 5""",
    "bm25_topk": f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20",
    "bm25_prefilter_lang": f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b WHERE lang = 'de' ORDER BY b.score DESC, doc_id LIMIT 20",
    "bm25_stored_index": f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20",
    "bm25_multi_query": _question_hits() + " SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5",
    "blockmax_prefilter": _question_hits() + """,
g AS (SELECT item_id, doc_id, round(sum(weight), 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(weight), 9) DESC, doc_id) AS rank FROM w JOIN q USING (term) WHERE lang = 'de' GROUP BY item_id, doc_id)
SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM g WHERE rank <= 3""",
    "rank_assign": f"SELECT vec_id, CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank FROM (SELECT vec_id, list_cosine_distance(embedding::DOUBLE[], {_VECTOR_SQL}) AS d FROM embeddings) QUALIFY rank <= 50",
    "rrf_fusion": f"""
WITH {_BM25},
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, list_cosine_distance(embedding::DOUBLE[], {_VECTOR_SQL}) AS d FROM embeddings) QUALIFY rank <= 50),
t AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 50)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM t) GROUP BY doc_id""",
    "hybrid_search": _hybrid_sql("") + _HYBRID_COLUMNS,
    "hybrid_scoped": _hybrid_sql("WHERE source IN ('src1', 'src2', 'src3')") + _HYBRID_COLUMNS,
    "search_hits_json": _hybrid_sql("") + """ SELECT doc_id, to_json({'doc_id': doc_id, 'origin': 'doc', 'text': text, 'vector_rank': CAST(vector_rank AS INTEGER), 'text_rank': CAST(text_rank AS INTEGER), 'score': CAST(round(round(fused, 9) * 1e9) AS BIGINT),
  'vector_distance': CAST(round(round(distance, 6) * 1e6) AS BIGINT), 'text_score': CAST(round(round(text_score, 6) * 1e6) AS BIGINT)})::VARCHAR AS hit FROM x JOIN documents USING (doc_id)""",
    "hash_embed_knn": f"""
WITH t AS (SELECT doc_id, CAST(('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket FROM (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents)),
b AS (SELECT doc_id, bucket, count(*) AS n FROM t GROUP BY ALL), l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM b GROUP BY doc_id),
x AS (SELECT q.doc_id AS query_id, e.doc_id, 1 - sum(q.n * e.n) / any_value(lq.len) / any_value(le.len) AS d FROM b q JOIN b e USING (bucket) JOIN l lq ON lq.doc_id = q.doc_id JOIN l le ON le.doc_id = e.doc_id WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, e.doc_id)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 12), doc_id) AS INTEGER) AS rank, abs(round(d, 5)) AS distance FROM x QUALIFY rank <= 3""",
    "distinct_files_first_rank": _question_hits() + _FILES + " SELECT item_id, source, CAST(position AS INTEGER) AS position, CAST(rank AS INTEGER) AS rank FROM fi WHERE rank <= 10",
    "first_gold_rank": _question_hits() + _FILES + " SELECT item_id, CAST(gold_rank AS INTEGER) AS gold_rank FROM g",
    "hit_at_k_grouping_sets": _question_hits() + _FILES + " SELECT mode, lang, n, round(hit_1, 6) AS hit_1, round(hit_3, 6) AS hit_3, round(hit_5, 6) AS hit_5 FROM rates",
    "mrr_at_10": _question_hits() + _FILES + " SELECT lang, round(mrr_10, 6) AS mrr_10 FROM rates",
    "report_pivot": _question_hits() + _FILES + " SELECT mode, round(any_value(hit_3) FILTER (WHERE lang = 'all'), 6) AS hit_3_all, round(any_value(hit_3) FILTER (WHERE lang = 'en'), 6) AS hit_3_en, round(any_value(hit_3) FILTER (WHERE lang = 'es'), 6) AS hit_3_es FROM rates GROUP BY mode",
    "median_latency": "SELECT event_type, round(median(value), 6) AS median, count(value) AS n FROM events GROUP BY event_type",
    "resumed_models": "SELECT model FROM (VALUES ('click'), ('view'), ('purchase'), ('never')) AS v(model) WHERE model NOT IN (SELECT event_type FROM events)",
    "whitelist_semi_join": "SELECT source AS root_id, count(*) AS n FROM documents WHERE source IN ('src3', 'src7') GROUP BY source",
    "origin_filter": "SELECT doc_id FROM documents WHERE doc_id % 3 = 0",
    "id_in_list": "SELECT doc_id, substr(sha256(source), 1, 4) AS file_id FROM documents WHERE source = 'src1' OR substr(sha256(source), 1, 4) IN ('0a1b', 'ffff', '5d2c')",
}

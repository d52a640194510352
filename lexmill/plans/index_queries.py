"""Queries over ignore rules, manifests and incremental maintenance, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import chunking as ch
from lexmill.operators import evaluate
from lexmill.operators import incremental as inc
from lexmill.plans.tables import literal_rows, table
from lexmill.plans.text_queries import _WINDOWS_SQL
from lexmill.sources import folder, ignore

def _snapshot(docs: DataFrame, salt: int) -> DataFrame:
    """A manifest that documents would have had: some rows missing, some changed."""
    changed = F.when(F.col("doc_id") % 7 == salt, F.lit("x")).otherwise(F.lit(""))
    content = F.concat("text", changed)
    return docs.filter(F.col("doc_id") % 11 != salt).select(
        F.col("source").alias("root_id"), F.col("doc_id").cast("string").alias("rel_path"), F.col("doc_id").cast("string").alias("file_id"), F.length(content).cast("long").alias("size"),
        (F.col("doc_id") * 1000 + F.when(F.col("doc_id") % 5 == 0, salt).otherwise(0)).alias("mtime_ns"), F.sha2(content, 256).alias("content_hash"), F.col("lang").alias("language"),
        (F.col("doc_id") % 4).alias("chunk_count"), F.when(F.col("doc_id") % 13 == 0, "unreadable").otherwise("indexed").alias("status"),
    )


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return _snapshot(docs, 1), _snapshot(docs, 2)


def manifest_diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return inc.classify(new, old).select("root_id", "rel_path", "status")


def content_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and new files by their content hash."""
    old, new = _snapshots(spark, sf_dir)
    changed = inc.classify(new, old).filter(F.col("status").isin("new", "candidate"))
    read = changed.join(new.select(*inc.FILE_KEY, "content_hash"), inc.FILE_KEY).withColumn("error", F.lit(None).cast("string")).withColumn("text", F.when(F.col("rel_path").cast("long") % 13 != 0, F.lit("t")))
    return inc.settle(read).select("root_id", "rel_path", "outcome")


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return inc.upsert(old, new, inc.FILE_KEY).select("root_id", "rel_path", "size", "content_hash")


def manifest_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return inc.delete(old, new, inc.FILE_KEY).select("root_id", "rel_path")


def stale_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.stale_roots(_snapshots(spark, sf_dir)[0], literal_rows(spark, ["('src0')", "('src1')"], "root_id"))


def replace_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "text", F.lit("text").alias("language"))
    chunks = ch.chunk_documents(docs, "file_id").select("file_id", "ordinal", F.lit("old").alias("version"))
    fresh = chunks.filter(F.col("file_id").cast("long") % 7 == 2).withColumn("version", F.lit("new"))
    gone = docs.filter(F.col("file_id").cast("long") % 11 == 1).select("file_id")
    return inc.replace_chunks(chunks, fresh, gone).select("file_id", "ordinal", "version")


def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    outcome = inc.classify(new, old).join(new.select(*inc.FILE_KEY, "content_hash", "chunk_count"), inc.FILE_KEY, "left")
    touched = (F.col("status") == "candidate") & (F.col("content_hash") == F.col("old_hash"))
    status = F.when(touched, "touched").when(F.col("status") == "candidate", "changed").otherwise(F.col("status"))
    return inc.report(outcome.select(status.alias("status"), F.when(status.isin("new", "changed"), F.col("chunk_count")).alias("n_chunks")))


def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.totals(_snapshots(spark, sf_dir)[0])


def distinct_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir)[0].select("root_id").distinct()


def walk_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why files of a listing are skipped (pages as files): links, placeholders, ignored ones, other kinds, languages, sizes."""
    number = F.col("page_id")
    kind = F.when(number % 9 == 0, "link").when(number % 10 == 0, "other").otherwise("file")
    pages = table(spark, sf_dir, "pages").select(F.length("html").alias("size"), kind.alias("kind"), F.when(number % 13 != 0, F.lit("html")).alias("language"), (number % 11 == 0).alias("ignored"), (number % 7 == 0).alias("placeholder"))
    return ignore.with_skip_reason(pages, 4000).groupBy("skip_reason").agg(F.count("*").alias("n"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as models and their parts as pinned files."""
    files = F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("long").alias("size")))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model")).agg(files.alias("files"))


def installed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 300th file is missing and every 211th has another size."""
    parts = table(spark, sf_dir, "part").filter("p_partkey % 300 <> 0")
    size = (F.col("p_size") + F.when(F.col("p_partkey") % 211 == 0, 1).otherwise(0)).cast("long")
    return evaluate.installed(_registry(spark, sf_dir), parts.select(F.col("p_brand").alias("model"), F.col("p_partkey").cast("string").alias("name"), size.alias("size")))


def index_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("event_type", F.lit(1).alias("items"), F.abs("value").alias("seconds"))
    return evaluate.throughput(runs, ["event_type"], "items", "seconds").select("event_type", "items", F.round("per_second", 6).alias("per_second"))


def max_end_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each document's lines that holds anything."""
    lines = ch.exploded_lines(table(spark, sf_dir, "documents"), "doc_id").filter(F.trim("line") != "")
    return lines.groupBy("doc_id").agg(F.max("i").alias("end_row"))


def question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as nested JSON, parsed as a query-set file is."""
    items = table(spark, sf_dir, "benchmark")
    nested = F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.create_map(F.lit("en"), F.col("text"), F.lit("es"), F.concat(F.lit("¿"), "text")).alias("questions"), F.array(F.concat(F.lit("src"), F.col("item_id") % 20)).alias("expected")))
    parsed = items.select(F.from_json(nested, "id string, questions map<string, string>, expected array<string>").alias("q")).select("q.*")
    return evaluate.exploded_questions(parsed).select("query_id", "lang", "question", F.array_join("files", ",").alias("files"))


def meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value table of sources, overwritten where there is something newer."""
    docs = table(spark, sf_dir, "documents")
    old = docs.groupBy(F.col("source").alias("key")).agg(F.count("*").cast("string").alias("value"))
    new = docs.filter("doc_id % 50 = 0").groupBy(F.col("source").alias("key")).agg(F.max("doc_id").cast("string").alias("value"))
    return inc.upsert(old, new, ["key"])


def decode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' bytes as files: with a byte order mark, with a NUL, in cp1252, and plain."""
    text, kind = F.col("text"), F.col("doc_id") % 4
    plain = F.regexp_replace(text, "[^\\x01-\\x7f]", "")
    data = F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary"))).when(kind == 1, F.concat(F.unhex(F.lit("00")), text.cast("binary"))).when(kind == 2, F.concat(plain.cast("binary"), F.unhex(F.lit("E9")))).otherwise(text.cast("binary"))
    decoded = folder.decoded(table(spark, sf_dir, "documents").select("doc_id", data.alias("data")), "data")
    return decoded.select("doc_id", F.md5("text").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        manifest_diff_status, content_settle, manifest_upsert, manifest_delete, stale_roots, replace_file_chunks, index_report, manifest_totals, distinct_roots, walk_counters,
        installed_models, index_throughput, max_end_row, question_set, meta_upsert, decode_files,
    )
}


def _snap(name: str, salt: int) -> str:
    return f"""{name} AS (SELECT source AS root_id, CAST(doc_id AS VARCHAR) AS rel_path, length(text) + (doc_id % 7 = {salt})::INT AS size, doc_id * 1000 + CASE WHEN doc_id % 5 = 0 THEN {salt} ELSE 0 END AS mtime_ns,
  sha256(text || CASE WHEN doc_id % 7 = {salt} THEN 'x' ELSE '' END) AS content_hash, doc_id % 4 AS chunk_count, CASE WHEN doc_id % 13 = 0 THEN 'unreadable' ELSE 'indexed' END AS status FROM documents WHERE doc_id % 11 <> {salt})"""


_BOTH = f"WITH {_snap('o', 1)}, {_snap('n', 2)}"
_DIFF = (
    _BOTH
    + """,
x AS (SELECT root_id, rel_path, n.content_hash, o.content_hash AS old_hash, n.chunk_count,
  CASE WHEN n.size IS NULL THEN 'removed' WHEN o.size IS NULL THEN 'new' WHEN n.size = o.size AND n.mtime_ns = o.mtime_ns THEN 'unchanged' ELSE 'candidate' END AS status
  FROM o FULL JOIN n USING (root_id, rel_path))"""
)
ORACLES = {
    "manifest_diff_status": _DIFF + " SELECT root_id, rel_path, status FROM x",
    "content_settle": _DIFF + " SELECT root_id, rel_path, CASE WHEN content_hash = old_hash THEN 'touched' WHEN CAST(rel_path AS BIGINT) % 13 = 0 THEN 'unreadable' ELSE 'indexed' END AS outcome FROM x WHERE status IN ('new', 'candidate')",
    "manifest_upsert": _BOTH + " SELECT root_id, rel_path, CAST(size AS BIGINT) AS size, content_hash FROM n UNION ALL SELECT root_id, rel_path, CAST(size AS BIGINT), content_hash FROM o ANTI JOIN n USING (root_id, rel_path)",
    "manifest_delete": _BOTH + " SELECT root_id, rel_path FROM o ANTI JOIN n USING (root_id, rel_path)",
    "stale_roots": f"WITH {_snap('o', 1)} SELECT DISTINCT root_id FROM o WHERE root_id NOT IN ('src0', 'src1')",
    "replace_file_chunks": _WINDOWS_SQL + """
SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN doc_id % 7 = 2 THEN 'new' ELSE 'old' END AS version FROM c WHERE doc_id % 7 = 2 OR doc_id % 11 <> 1""",
    "index_report": _DIFF + """
, y AS (SELECT CASE WHEN status <> 'candidate' THEN status WHEN content_hash = old_hash THEN 'touched' ELSE 'changed' END AS status, chunk_count FROM x)
SELECT count(*) FILTER (WHERE status IN ('new', 'changed')) AS indexed, count(*) FILTER (WHERE status IN ('unchanged', 'touched')) AS unchanged, count(*) FILTER (WHERE status = 'removed') AS removed,
  CAST(0 AS BIGINT) AS unreadable, CAST(coalesce(sum(chunk_count) FILTER (WHERE status IN ('new', 'changed')), 0) AS BIGINT) AS chunks FROM y""",
    "manifest_totals": f"WITH {_snap('o', 1)} SELECT count(*) AS files, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks FROM o WHERE status = 'indexed'",
    "distinct_roots": f"WITH {_snap('o', 1)} SELECT DISTINCT root_id FROM o",
    "walk_counters": "SELECT CASE WHEN page_id % 9 = 0 THEN 'link' WHEN page_id % 7 = 0 THEN 'placeholder' WHEN page_id % 11 = 0 THEN 'ignored' WHEN page_id % 10 = 0 THEN 'other' WHEN page_id % 13 = 0 THEN 'unsupported' WHEN length(html) > 4000 THEN 'too_large' END AS skip_reason, count(*) AS n FROM pages GROUP BY 1",
    "installed_models": """
WITH f AS (SELECT p_brand AS model, p_partkey, CAST(p_size AS BIGINT) AS pinned, p_partkey % 300 <> 0 AND p_partkey % 211 <> 0 AS there FROM part)
SELECT model, CAST(sum(pinned) AS BIGINT) AS total_size, count(*) FILTER (WHERE NOT there) AS n_missing, bool_and(there) AS is_installed FROM f GROUP BY model""",
    "index_throughput": "SELECT event_type, count(*) AS items, round(count(*) / nullif(sum(abs(value)), 0), 6) AS per_second FROM events GROUP BY event_type",
    "max_end_row": "WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS a FROM documents)) SELECT doc_id, CAST(max(i) AS INTEGER) AS end_row FROM l WHERE trim(line) <> '' GROUP BY doc_id",
    "question_set": "SELECT CAST(item_id AS VARCHAR) AS query_id, lang, CASE WHEN lang = 'en' THEN text ELSE '¿' || text END AS question, 'src' || (item_id % 20) AS files FROM benchmark, (VALUES ('en'), ('es')) AS v(lang)",
    "meta_upsert": "SELECT source AS key, CAST(coalesce(max(doc_id) FILTER (WHERE doc_id % 50 = 0), count(*)) AS VARCHAR) AS value FROM documents GROUP BY source",
    "decode_files": r"SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN NULL WHEN 2 THEN md5(regexp_replace(text, '[^\x01-\x7f]', '', 'g') || 'é') ELSE md5(text) END AS digest FROM documents",
}

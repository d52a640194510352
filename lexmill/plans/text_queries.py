"""Queries over text functions, lines and chunks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions.languages import extension
from lexmill.operators import chunking as ch
from lexmill.operators import search
from lexmill.operators import vectors as vx
from lexmill.plans.tables import literal_rows, table

QUESTIONS = ["¿Cómo se calcula el daño de un ataque crítico?", "Where is the user validated?", "¿Dónde está?", '¿Dónde "se" valida getUserById? (AND -x)', "The Best of THE best"]
ENDINGS = ["1, 'a\\r\\nb\\rc\\nd'", "2, 'one\\n'", "3, ''", "4, '\\n\\n'", "5, 'x\\r\\n\\r\\ny\\r'"]


def _sql_list(values: list[str]) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


def _parts(token: str) -> str:
    """DuckDB: the parts of an identifier, by borders that are marked one kind after the other."""
    marked = token
    for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Nd})([^\p{Nd}_])", r"([^\p{Nd}_])(\p{Nd})", r"(\p{Lu})(\p{Lu}\p{Ll})"):
        marked = f"regexp_replace({marked}, '{pattern}', '\\1_\\2', 'g')"
    return f"list_filter(string_split({marked}, '_'), lambda p: p <> '')"


def _expanded(text: str) -> str:
    return rf"flatten(list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+'), lambda w: CASE WHEN len({_parts('w')}) > 1 THEN list_concat([w], {_parts('w')}) ELSE [w] END))"


WORDS_SQL = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda w: lower(w))"


def folded_sql(word: str) -> str:
    """DuckDB: a term as the text index spells it."""
    out = f"strip_accents(lower({word}))"
    for letter, plain in (("ø", "o"), ("đ", "d"), ("ħ", "h"), ("ł", "l"), ("ŧ", "t"), ("ŋ", "n"), ("ð", "d"), ("ı", "i"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th")):
        out = f"replace({out}, '{letter}', '{plain}')"
    return out


TERMS_SQL = rf"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+'), lambda w: {folded_sql('w')})"


def expand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_name").union(table(spark, sf_dir, "events").select("event_type"))
    return words.select(F.explode(tx.expand(F.col("p_name"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def query_terms_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = literal_rows(spark, [f"('{v}')" for v in QUESTIONS], "text").union(table(spark, sf_dir, "benchmark").select("text"))
    return asked.distinct().select("text", tx.text_query(F.col("text")).alias("terms"))


_QUESTION_SQL = rf"""
WITH q AS (SELECT DISTINCT text FROM (SELECT * FROM (VALUES {_sql_list(QUESTIONS)}) AS v(text) UNION ALL SELECT text FROM benchmark)),
t AS (SELECT text, list_transform(list_filter({_expanded('text')}, lambda w: NOT list_contains([{', '.join(f"'{w}'" for w in sorted(tx.QUERY_STOP_WORDS))}], strip_accents(lower(w)))), lambda w: lower(w)) AS ws FROM q)
SELECT text, coalesce(array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:64], ' '), '') AS terms FROM t
"""


def search_text_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", tx.search_text(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("search_text"))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_frequencies(search.postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = search.document_lengths(search.postings(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return search.corpus_stats(lengths).select("n", F.round("avgdl", 6).alias("avgdl"))


def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", "text").select("term", "doc_id", "tf")


def normalize_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = literal_rows(spark, [f"({r})" for r in ENDINGS], "id, text").select(F.col("id").cast("long").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), F.col("html").alias("text"))
    return own.union(pages).select("id", F.md5(tx.normalize_newlines(F.col("text"))).alias("digest"))


def split_lines_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = literal_rows(spark, [f"({r})" for r in ENDINGS], "id, text").select((-F.col("id")).cast("long").alias("doc_id"), "text")
    docs = own.union(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size(tx.split_lines(F.col("text"))).cast("long").alias("n_lines"))


def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = literal_rows(spark, ["(-1, ' ')", "(-2, '\\n\\t\\n')", "(-3, 'x')"], "doc_id, text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ch.filled_documents(own.union(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id")


def line_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.line_ends(ch.exploded_lines(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("text").alias("language"))


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.chunk_documents(_plain(spark, sf_dir), "doc_id").select("doc_id", "ordinal", "start_line", "end_line")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = ch.chunk_documents(_plain(spark, sf_dir), "doc_id")
    return chunks.select("doc_id", tx.chunk_id(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16), F.col("ordinal")).alias("id"), "start_line", "end_line", F.md5("text").alias("digest"))


_LINES_SQL = r"""
l0 AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS a FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM l0),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i, len(a) AS n FROM l1),
e AS (SELECT doc_id, i, n, line, length(line) + 1 AS size, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS end_size FROM l)"""
_WINDOWS_SQL = (
    "WITH RECURSIVE"
    + _LINES_SQL
    + r""",
r AS (  -- the last line of a window that starts at each line
  SELECT a.doc_id, a.i, a.n, greatest(a.i, max(b.i) FILTER (WHERE b.end_size - a.end_size + a.size <= 1800)) AS last
  FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i <= a.i + 1800 GROUP BY a.doc_id, a.i, a.n),
w AS (
  SELECT doc_id, i, coalesce(last, i) AS last, n FROM r WHERE i = 0
  UNION ALL
  SELECT r.doc_id, r.i, coalesce(r.last, r.i), r.n FROM w JOIN r ON r.doc_id = w.doc_id AND r.i = greatest(w.last + 1 - 3, w.i + 1) WHERE w.last < w.n - 1),
t AS (
  SELECT w.doc_id, w.i AS first, min(e.i) AS a, max(e.i) AS b FROM w JOIN e ON e.doc_id = w.doc_id AND e.i BETWEEN w.i AND w.last
  WHERE regexp_replace(e.line, '[\s\x0b\x1c-\x1f\x{85}\x{a0}]+', '', 'g') <> '' GROUP BY w.doc_id, w.i),
c AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS ordinal FROM t)"""
)


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text").cast("binary")).alias("content_hash"))


def stable_id_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.stable_id(F.col("source"), F.col("doc_id")).alias("file_id"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(tx.stable_id(F.col("source"), F.col("doc_id")).alias("file_id"), F.posexplode(tx.split_lines(F.col("text"))).alias("ordinal", "line"))
    return docs.select(tx.chunk_id(F.col("file_id"), F.col("ordinal")).alias("id"), F.length("line").alias("n_chars"))


def ext_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(extension(F.regexp_replace("url", r"[?#].*$", "")).alias("ext"))
    return pages.groupBy("ext").agg(F.count("*").alias("n"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(tx.embedding_text(F.col("source"), F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")), F.col("text"))).alias("digest"))


def preview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.preview(F.col("text")), "|").alias("preview"))


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vx.hash_embedding(table(spark, sf_dir, "documents"), "doc_id")
    return vectors.select("doc_id", F.posexplode("vector").alias("bucket", "value")).filter("value > 0").select("doc_id", "bucket", F.round("value", 6).alias("value"))


def embed_batches_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vx.batches_of_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def fold_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("token")).distinct()
    return tokens.select("token", tx.fold(F.col("token")).alias("folded"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order books as Markdown, a section for each order: cut between sections, as many to a piece as fit."""
    order = F.concat(F.lit("## Order "), F.col("o_orderkey"), F.lit("\nPriority "), F.col("o_orderpriority"), F.lit(", status "), F.col("o_orderstatus"), F.lit("\n"))
    books = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_custkey") / 25).cast("long").alias("book")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", order.alias("part")))).alias("parts"))
    text = F.concat(F.lit("# Book "), F.col("book").cast("string"), F.lit("\n"), F.array_join("parts.part", ""))
    chunks = ch.chunk_documents(books.select("book", text.alias("text"), F.lit("markdown").alias("language")), "book")
    return chunks.select("book", "ordinal", "start_line", "end_line", "symbol", F.md5("text").alias("digest"))


def syntax_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured chunks of the documents as Markdown (no SQL: see the tests)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Document\n"), F.replace("text", F.lit("\n"), F.lit("\n## Part\n"))).alias("text"), F.lit("markdown").alias("language"))
    return ch.chunk_documents(docs, "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        expand_terms, query_terms_stopwords, search_text_build, term_df, doc_length_stats, postings_build, normalize_newlines, split_lines_counts, blank_filter, line_prefix_sums,
        line_windows, chunk_rows, content_hash, stable_id_sha, chunk_ids, ext_histogram, embedding_texts, preview_lines, hash_embed, embed_batches_by_cost, syntax_chunks, markdown_sections, fold_terms,
    )
}

_ENDINGS_SQL = ", ".join("(" + r.replace("'", "E'", 1) + ")" for r in ENDINGS)
ORACLES = {
    "expand_terms": rf"""
SELECT term, count(*) AS n FROM (SELECT unnest({_expanded('x')}) AS term FROM (SELECT p_name AS x FROM part UNION ALL SELECT event_type FROM events)) GROUP BY term""",
    "query_terms_stopwords": _QUESTION_SQL,
    "search_text_build": f"SELECT p_partkey, array_to_string(list_concat({_expanded('p_brand')}, {_expanded('p_type')}, {_expanded('p_name')}), ' ') AS search_text FROM part",
    "term_df": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY term",
    "doc_length_stats": f"SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM (SELECT len({TERMS_SQL}) AS dl FROM documents) WHERE dl > 0",
    "postings_build": f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY term, doc_id",
    "normalize_newlines": f"""
SELECT CAST(id AS BIGINT) AS id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest
FROM (SELECT id, text FROM (VALUES {_ENDINGS_SQL}) AS v(id, text) UNION ALL SELECT page_id + 1000, html FROM pages)""",
    "split_lines_counts": f"""
WITH s AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS a
  FROM (SELECT -id AS doc_id, text FROM (VALUES {_ENDINGS_SQL}) AS v(id, text) UNION ALL SELECT doc_id, text FROM documents))
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(CASE WHEN a[-1] = '' THEN len(a) - 1 ELSE len(a) END AS BIGINT) AS n_lines FROM s""",
    "blank_filter": r"""
SELECT CAST(doc_id AS BIGINT) AS doc_id FROM (SELECT doc_id, text FROM (VALUES (-1, ' '), (-2, E'\n\t\n'), (-3, 'x')) AS v(doc_id, text) UNION ALL SELECT doc_id, text FROM documents)
WHERE regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> ''""",
    "line_prefix_sums": "WITH" + _LINES_SQL + " SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(size AS INTEGER) AS size, CAST(end_size AS BIGINT) AS end_size FROM e",
    "line_windows": _WINDOWS_SQL + " SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(a + 1 AS INTEGER) AS start_line, CAST(b + 1 AS INTEGER) AS end_line FROM c",
    "chunk_rows": _WINDOWS_SQL + r""",
x AS (SELECT c.doc_id, c.ordinal, c.a, c.b, string_agg(e.line, chr(10) ORDER BY e.i) AS text FROM c JOIN e ON e.doc_id = c.doc_id AND e.i BETWEEN c.a AND c.b GROUP BY ALL)
SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) || '-' || printf('%05d', ordinal) AS id, CAST(a + 1 AS INTEGER) AS start_line, CAST(b + 1 AS INTEGER) AS end_line, md5(text) AS digest FROM x""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "stable_id_sha": "SELECT doc_id, substr(sha256(encode(source) || '\\x00'::BLOB || encode(CAST(doc_id AS VARCHAR))), 1, 16) AS file_id FROM documents",
    "chunk_ids": "WITH" + _LINES_SQL + r"""
SELECT substr(sha256(encode(d.source) || '\x00'::BLOB || encode(CAST(e.doc_id AS VARCHAR))), 1, 16) || '-' || printf('%05d', e.i) AS id, CAST(length(line) AS INTEGER) AS n_chars FROM e JOIN documents d USING (doc_id)""",
    "ext_histogram": r"SELECT regexp_extract(lower(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1]), '^\.*[^.].*?(\.[^.]*)$', 1) AS ext, count(*) AS n FROM pages GROUP BY 1",
    "embedding_texts": r"""SELECT doc_id, md5(substr(CASE WHEN lang = 'en' THEN source ELSE source || chr(10) || lang END || chr(10) || chr(10) || text, 1, 2000)) AS digest FROM documents""",
    "preview_lines": "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10))[1:4], lambda x: substr(x, 1, 110)), '|') AS preview FROM documents",
    "hash_embed": f"""
WITH t AS (SELECT doc_id, CAST(('0x' || substr(sha256(term), 1, 8))::BIGINT % 128 AS INTEGER) AS bucket FROM (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents)),
b AS (SELECT doc_id, bucket, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM b""",
    "embed_batches_by_cost": """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents),
r AS (SELECT doc_id, n, CAST(least(256, greatest(1, floor(4194304 / pow(greatest(floor(n / 2), 1), 2)))) AS BIGINT) AS room FROM d)
SELECT doc_id, room, (row_number() OVER (PARTITION BY room ORDER BY n, doc_id) - 1) // room AS batch FROM r""",
    "markdown_sections": r"""
WITH RECURSIVE
o AS (SELECT o_custkey // 25 AS book, row_number() OVER (PARTITION BY o_custkey // 25 ORDER BY o_orderkey) AS i, ' > Order ' || o_orderkey AS name, '## Order ' || o_orderkey || chr(10) || 'Priority ' || o_orderpriority || ', status ' || o_orderstatus AS body FROM orders),
u AS (SELECT * FROM o UNION ALL SELECT DISTINCT book, 0, '', '# Book ' || book FROM o),
p AS (
  SELECT book, i, 0 AS ordinal, length(body) + 1 AS held FROM u WHERE i = 0
  UNION ALL
  SELECT u.book, u.i, CASE WHEN held + length(body) + 1 <= 1800 THEN ordinal ELSE ordinal + 1 END, CASE WHEN held + length(body) + 1 <= 1800 THEN held ELSE 0 END + length(body) + 1 FROM p JOIN u ON u.book = p.book AND u.i = p.i + 1)
SELECT book, CAST(ordinal AS INTEGER) AS ordinal, CAST(greatest(1, 2 * min(i)) AS INTEGER) AS start_line, CAST(2 * max(i) + 1 AS INTEGER) AS end_line, 'Book ' || book || arg_min(name, i) AS symbol, md5(string_agg(body, chr(10) ORDER BY i)) AS digest
FROM p JOIN u USING (book, i) GROUP BY book, ordinal""",
    "fold_terms": "SELECT DISTINCT token, strip_accents(lower(token)) AS folded FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents)",
}

"""Benchmark decontamination by a prefix-filtered join (DataFrame operations only).

A benchmark item is cut into windows of ``window`` consecutive words (an item that is
shorter, but not empty, is one window).  A window occurs in a document exactly when its
words stand there in a row, so the wanted containment is 1 and the necessary prefix of a
window is its rarest shingle:

1. the benchmark's words are counted in the documents, which orders the shingles of each window
   by rarity; only the rarest is its prefix, and only prefixes are joined with the documents;
2. up to ``BROADCAST_ROWS`` prefixes are broadcast (they are counted first), and one pass over the
   documents keeps the shingles that are some prefix, with the words around them; more are
   joined by a shuffle of (row, position, hash) alone;
3. the shingle's offset in the window gives the only possible start; a match that would
   reach over either end of the document is dropped (positional and length bounds);
4. what is left is verified word by word.

Defined cases: null or empty texts have no words and are never hit; items without words or
without an id are ignored; repeated rows each get their own result row; columns other than
those named are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_lower, broadcast_if_small, materialize, table, text_or_empty

#: Everything in ASCII but digits and letters parts words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: Shingles (two numbers each), words or windows that are broadcast at most.
BROADCAST_ROWS = 500_000


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAK), "")


def shingle_hash(words: Column, position: Column, size: int) -> Column:
    """Hash of the ``size`` words from 0-based ``position``; null where they don't fit."""
    return F.when(position + size <= F.size(words), F.xxhash64(*(F.get(words, position + i) for i in range(size))))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, w_words): each item's windows."""
    items = benchmark.select("item_id", word_array(text_or_empty()).alias("words"))
    items = items.filter(F.col("item_id").isNotNull() & (F.size("words") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return items.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), window).alias("w_words")).distinct()


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(item_id, w_words, w_offset, k, h): every shingle of every window."""
    k = F.least(F.size("w_words"), F.lit(shingle))
    at = windows.withColumn("k", k).withColumn("w_offset", F.explode(F.sequence(F.lit(0), F.size("w_words") - F.col("k"))))
    by_size = reduce(lambda rest, size: F.when(F.col("k") == size, shingle_hash(F.col("w_words"), F.col("w_offset"), size)).otherwise(rest), range(1, shingle + 1), F.lit(None).cast("long"))
    return at.withColumn("h", by_size)


def _word_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(word, n): how often each of the benchmark's words stands in the documents."""
    wanted = windows.select(F.explode("w_words").alias("word")).distinct()
    wanted = materialize(wanted, "benchmark-words")
    said = docs.select(F.explode(word_array(text_or_empty())).alias("word"))
    if wanted.count() <= BROADCAST_ROWS:
        return said.join(F.broadcast(wanted), "word").groupBy("word").agg(F.count("*").alias("n"))
    # Words are counted before the join, so that a frequent word is one row of each task and not a key of many.
    return said.groupBy("word").agg(F.count("*").alias("n")).join(wanted, "word", "left_semi")


def _prefixes(docs: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """(item_id, w_words, k, h, w_offset): the necessary prefix of each window, its rarest shingle.

    A shingle is as rare as its rarest word in the documents, and then as their sum.  A window
    with a word that no document has cannot occur and has no prefix."""
    numbered = windows.withColumn("window", F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered-windows")
    words = numbered.select("window", F.posexplode("w_words").alias("place", "word")).join(materialize(_word_counts(docs, windows), "word-counts"), "word")
    counts = words.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("counts"))
    known = numbered.join(counts, "window").filter(F.size("counts") == F.size("w_words")).drop("window")
    at = _window_shingles(known, shingle)
    own = F.slice(F.col("counts.n"), F.col("w_offset") + 1, F.col("k"))
    rarity = F.struct(F.array_min(own).alias("rarest_word"), F.aggregate(own, F.lit(0.0), lambda a, n: a + F.log2(n)).alias("all_words"), "h", "w_offset")
    ranked = at.groupBy("item_id", "w_words", "k").agg(F.min(rarity).alias("first"))
    return ranked.select("item_id", "w_words", "k", "first.h", "first.w_offset")


def _hashes(words: Column, pos: Column, sizes: list[int]) -> Column:
    """(k, h) of the shingles that begin at a position and end within the words."""
    each = [F.when(pos + s <= F.size(words), F.struct(F.lit(s).alias("k"), shingle_hash(words, pos, s).alias("h"))) for s in sizes]
    return F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast("array<struct<k:int,h:bigint>>")


def _spans_in_one_pass(docs: DataFrame, prefix: DataFrame, keys: DataFrame, sizes: list[int], window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The documents (row_id, doc_id, n_words) and the spans (row_id, start, end, item_id) of windows
    in them, with ``keys`` broadcast: one pass keeps a row for each known shingle, with the words
    around it, and a closing row for each document."""
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), word_array(text_or_empty()).alias("words"))
    # One place more than there are words: the closing row.
    at = base.select("*", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    for size in sizes:
        known = F.broadcast(keys.filter(F.col("k") == size).select(F.col("h").alias(f"h{size}"), F.lit(True).alias(f"is{size}")))
        at = at.withColumn(f"h{size}", shingle_hash(F.col("words"), F.col("pos"), size)).join(known, f"h{size}", "left")
    last = F.col("pos") == F.size("words")
    found = at.filter(reduce(lambda a, b: a | b, (F.col(f"is{s}").isNotNull() for s in sizes), last))
    context_start = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    context = F.when(~last, F.slice("words", context_start + 1, 2 * window + shingle))
    hits = F.filter(F.array(*(F.when(F.col(f"is{s}"), F.struct(F.lit(s).alias("k"), F.col(f"h{s}").alias("h"))) for s in sizes)), lambda x: x.isNotNull()) if sizes else F.array().cast("array<struct<k:int,h:bigint>>")
    shared = materialize(found.select("row_id", "doc_id", "pos", F.size("words").alias("n_words"), context_start.alias("context_start"), context.alias("context"), hits.alias("hits"), last.alias("closing")), "shared-shingles")
    found = shared.filter(~F.col("closing")).select("row_id", "pos", "n_words", "context_start", "context", F.explode("hits").alias("s")).select("*", "s.k", "s.h").drop("s")
    start, length = F.col("pos") - F.col("w_offset"), F.size("w_words")
    candidates = found.join(broadcast_if_small(prefix, BROADCAST_ROWS), ["k", "h"]).filter((start >= 0) & (start + length <= F.col("n_words")))
    verified = candidates.filter(F.slice("context", start - F.col("context_start") + 1, length) == F.col("w_words"))
    return shared.filter("closing").select("row_id", "doc_id", "n_words"), verified.select("row_id", start.alias("start"), (start + length).alias("end"), "item_id")


def _spans_by_shuffle(docs: DataFrame, prefix: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """The same for a benchmark of any size: documents' shingles are shuffled as three numbers each, and
    what has a partner is verified after a join by row.  No row of a word carries its document."""
    base = materialize(docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), word_array(text_or_empty()).alias("words")), "document-words")
    at = base.select("row_id", "words", F.posexplode("words").alias("pos", "word")).select("row_id", "pos", F.explode(_hashes(F.col("words"), F.col("pos"), sizes)).alias("s"))
    start, length = F.col("pos") - F.col("w_offset"), F.size("w_words")
    candidates = at.select("row_id", "pos", "s.k", "s.h").join(prefix, ["k", "h"]).filter(start >= 0).select("row_id", start.alias("start"), "item_id", "w_words")
    verified = base.join(candidates, "row_id").filter((F.col("start") + length <= F.size("words")) & (F.slice("words", F.col("start") + 1, length) == F.col("w_words")))
    return base.select("row_id", "doc_id", F.size("words").alias("n_words")), verified.select("row_id", "start", (F.col("start") + length).alias("end"), "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = materialize(benchmark_windows(benchmark, window), "windows")
    prefix = materialize(_prefixes(docs, windows, shingle), "prefix")
    keys = materialize(prefix.select("k", "h").distinct(), "prefix-shingles")
    sizes = sorted(r.k for r in keys.select("k").distinct().collect())  # at most ``shingle`` values
    if keys.count() <= BROADCAST_ROWS:
        documents, spans = _spans_in_one_pass(docs, prefix, keys, sizes, window, shingle)
    else:
        documents, spans = _spans_by_shuffle(docs, prefix, sizes)

    per_document = spans.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.collect_set("item_id").alias("items"))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    union = F.aggregate(
        "spans", zero,
        lambda a, s: F.struct((a.covered + F.greatest(s.end - F.greatest(s.start, a.end), F.lit(0))).alias("covered"), F.greatest(a.end, s.end).alias("end")),
        lambda a: a.covered,
    )
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    per_document = per_document.select("row_id", union.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("listed"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return documents.join(per_document, "row_id", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows (all their columns) in which no benchmark window occurs.  A hit depends on the text
    alone, so rows are told apart by its SHA-256 and never by their ids, which may be null or repeated."""
    text_hash = F.unhex(F.sha2("text", 256))
    hit = contamination(docs.select(text_hash.alias("doc_id"), "text"), benchmark, window, shingle).filter("contaminated").select(F.col("doc_id").alias("hit_hash")).distinct()
    hit = materialize(hit, "contaminated")
    # Repeated texts share a hash: beyond the bound Spark splits such keys of the left side while it runs.
    return docs.join(broadcast_if_small(hit, BROADCAST_ROWS), text_hash == hit["hit_hash"], "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
i AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
w AS (
  SELECT DISTINCT item_id, list_aggregate(ws[s : s + 9], 'string_agg', ' ') AS win, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS s FROM i WHERE len(ws) > 0)),
p AS (
  SELECT row_id, s, n, list_aggregate(ws[s : s + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT row_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
m AS (SELECT p.row_id, p.s, p.n, w.item_id FROM p JOIN w ON p.win = w.win AND p.n = w.n),
h AS (SELECT row_id, count(DISTINCT pos) AS n_hit FROM (SELECT row_id, unnest(generate_series(s, s + n - 1)) AS pos FROM m) GROUP BY row_id),
t AS (SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY row_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row_id) LEFT JOIN t USING (row_id)
"""

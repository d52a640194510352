"""Queries over source texts that are made of the order books: symbols, chunks, and folds over pieces.

A book is a customer group's orders written as a source of each language: lines around the whole, and
some for each order.  Every line is listed with the symbol that is over it, so the SQL knows the
truth without looking at the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import chunking as ch
from lexmill.plans.tables import table
from lexmill.plans.text_queries import _WINDOWS_SQL, _plain

#: Per language: lines before the orders, of each order, and behind them, each with its symbol; ``{b}`` is the
#: book, ``{k}`` the order's key, ``{s}`` its status.
SOURCES = {
    "python": (
        [('"""Book {b}', ""), ("def nope():", ""), ('"""', ""), ("import os", ""), ("", ""), ("class Book_{b}:", "Book_{b}"), ("    size = 1", "Book_{b}")],
        [("", "Book_{b}"), ("    @cached", "Book_{b} > order_{k}"), ("    def order_{k}(self, x,", "Book_{b} > order_{k}"), ("            y):", "Book_{b} > order_{k}"), ('        note = """', "Book_{b} > order_{k}"), ("def fake_{k}():", "Book_{b} > order_{k}"), ('"""', "Book_{b} > order_{k}"), ("        return {", "Book_{b} > order_{k}"), ('"{s}": 1}', "Book_{b} > order_{k}")],
        [("", ""), ("", ""), ("if __name__ == '__main__':", ""), ("    Book_{b}()", ""), ("LIMIT_{b} = 1", "")],
    ),
    "javascript": (
        [("// Book {b}", "Book_{b}"), ("class Book_{b} {", "Book_{b}"), ("  size = 1;", "Book_{b}")],
        [("  // order {k}", "Book_{b} > order_{k}"), ("  order_{k}(a, b) {", "Book_{b} > order_{k}"), ('    if (a) { return "}"; }', "Book_{b} > order_{k}"), ("    return `${b}{ {s}`;", "Book_{b} > order_{k}"), ("  }", "Book_{b} > order_{k}")],
        [("}", "Book_{b}"), ("const total_{b} = (x) =>", "total_{b}"), ("  x + 1;", "total_{b}"), ("module.exports = { total_{b} };", "")],
    ),
    "dart": (
        [("import 'book.dart';", ""), ("class Book_{b} {", "Book_{b}"), ("  final int size = of(3);", "Book_{b}")],
        [("  /// order {k}", "Book_{b} > order_{k}"), ("  Future<int> order_{k}(String e) async {", "Book_{b} > order_{k}"), ("    print('}{s}');", "Book_{b} > order_{k}"), ("  }", "Book_{b} > order_{k}"), ("  bool get is_{k} => true;", "Book_{b} > is_{k}")],
        [("}", "Book_{b}"), ("void main() {", "main"), ("  run({b});", "main"), ("}", "main"), ("final limit = 3;", "")],
    ),
    "lua": (
        [("local M = {}", ""), ("--[[ function nope()", "M.book_{b}"), ("]]", "M.book_{b}"), ("function M.book_{b}(x)", "M.book_{b}"), ("  return x", "M.book_{b}"), ("end", "M.book_{b}")],
        [("M.order_{k} = function(a)", "M.order_{k}"), ('  if a then return "end {s}" end', "M.order_{k}"), ("  for i = 1, 2 do print(i) end", "M.order_{k}"), ("end", "M.order_{k}"), ("M.last = {k}", "")],
        [("return M", "")],
    ),
    "yaml": (
        [("book_{b}:", "book_{b}")],
        [("  order_{k}:", "book_{b} > order_{k}"), ("    note: |", "book_{b} > order_{k} > note"), ("      fake: {s}", "book_{b} > order_{k} > note"), ("    list:", "book_{b} > order_{k} > list"), ("    - item: 1", "book_{b} > order_{k} > list > item")],
        [("end: 1", "end")],
    ),
    "json": (
        [("{", ""), ('  "book_{b}": {', "book_{b}")],
        [('    "order_{k}": {', "book_{b} > order_{k}"), ('      "status": "{s}{"', "book_{b} > order_{k} > status"), ("    },", "book_{b} > order_{k}")],
        [('    "last": 0', "book_{b} > last"), ("  },", "book_{b}"), ('  "end": 1', "end"), ("}", "")],
    ),
    "markdown": (
        [("intro", ""), ("# Book {b}", "Book {b}"), ("text", "Book {b}"), ("", "Book {b}")],
        [("Order {k}", "Book {b} > Order {k}"), ("---", "Book {b} > Order {k}"), ("~~~", "Book {b} > Order {k}"), ("# {s}", "Book {b} > Order {k}"), ("~~~", "Book {b} > Order {k}")],
        [("# End", "End")],
    ),
}
#: Markdown for the windows over headings, with headings of three levels.
HEADINGS = {
    "headings": (
        [("no heading", ""), ("# Book {b}", "Book {b}"), ("intro", "Book {b}")],
        [("## Order {k} ##", "Book {b} > Order {k}"), ("text", "Book {b} > Order {k}"), ("### Status {s}", "Book {b} > Order {k} > Status {s}"), ("#no heading", "Book {b} > Order {k} > Status {s}")],
        [("# End", "End"), ("### Deep", "End > Deep")],
    ),
}
GROUP = 25
#: What the sources of a partition are meant to hold, roughly: all of them may be one Arrow batch.
PARTITION_BYTES = 4 << 20
CONFIG = ch.ChunkConfig()


def _filled(template: str, book: Column, key: Column | None = None, status: Column | None = None) -> Column:
    out = F.replace(F.lit(template), F.lit("{b}"), book.cast("string"))
    return out if key is None else F.replace(F.replace(out, F.lit("{k}"), key.cast("string")), F.lit("{s}"), status)


def _books(spark: SparkSession, sf_dir: str, languages: list[str], sources: dict = SOURCES) -> DataFrame:
    """(id, language, text): the books as sources."""
    orders = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / GROUP).cast("long").alias("book"), "o_orderkey", "o_orderstatus")
    # The orders are few bytes, the sources that are made of them many: partitions are counted by the latter.
    size = sum(len(line) + 20 for language in languages for line, _ in sources[language][1])
    dealt = orders.repartition(max(spark.sparkContext.defaultParallelism, orders.count() * size // PARTITION_BYTES), "book")
    books = dealt.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("orders"))

    def source(language: str) -> Column:
        head, part, foot = ("\n".join(line for line, _ in own) for own in sources[language])
        own = F.transform("orders", lambda o: _filled(part, F.col("book"), o["o_orderkey"], o["o_orderstatus"]))
        return F.concat_ws("\n", _filled(head, F.col("book")), F.array_join(own, "\n"), _filled(foot, F.col("book")))

    # A row holds the source of one language: those of all in one row would be many times a long book's orders.
    each = books.select("book", "orders", F.explode(F.array(*map(F.lit, languages))).alias("language"))
    text = reduce(lambda others, language: F.when(F.col("language") == language, source(language)).otherwise(others), languages, F.lit(None).cast("string"))
    return each.select(F.concat_ws("-", "language", F.col("book").cast("string")).alias("id"), "language", text.alias("text"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost definition, heading or key over every line."""
    return ch.line_symbols(_books(spark, sf_dir, list(SOURCES)), "id").select("id", "i", "symbol")


def unit_end_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last row over which each definition, heading or key is the innermost one."""
    return ch.unit_rows(_books(spark, sf_dir, list(SOURCES)), "id")


def heading_symbol_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of headings over every line, by window functions alone."""
    lines = ch.exploded_lines(_books(spark, sf_dir, list(HEADINGS), HEADINGS), "id")
    return ch.heading_paths(lines, "id").select("id", "i", "symbol")


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python sources in chunks: methods packed side by side, what is small merged."""
    chunks = ch.chunk_documents(_books(spark, sf_dir, ["python"]), "id", CONFIG)
    return chunks.select("id", "ordinal", "start_line", "end_line", "symbol", F.length("text").alias("n_chars"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), ch.pieces_column(F.col("text"), F.col("language"), CONFIG).alias("pieces"))


def remove_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping line windows, each pushed past the end of those before it and trimmed."""
    rows = _pieces(spark, sf_dir).select("doc_id", F.explode_outer(ch.trimmed(ch.without_overlaps(F.col("pieces")), ch.split_lines(F.col("text")))).alias("piece"))
    return rows.filter(F.col("piece").isNotNull()).select("doc_id", "piece.first", "piece.last")


def merge_small_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line a piece, with one or two names over it; small ones are merged."""
    lines = ch.line_ends(ch.exploded_lines(table(spark, sf_dir, "documents"), "doc_id"), "doc_id").select("doc_id", "i", "size", "end_size")
    names = F.when(F.col("size") % 3 == 0, F.array(F.lit("line"), F.col("i").cast("string"))).otherwise(F.array(F.lit("line")))
    piece = F.struct(F.col("i").alias("first"), F.col("i").alias("last"), (F.col("end_size") - F.col("size")).alias("start_at"), F.col("end_size").alias("end_at"), names.alias("names"))
    pieces = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(piece)).cast(f"array<{ch.PIECE}>").alias("pieces"))
    rows = pieces.select("doc_id", F.posexplode(ch.merged_small(F.col("pieces"), CONFIG)).alias("ordinal", "piece"))
    return rows.select("doc_id", "ordinal", "piece.first", "piece.last", F.array_join("piece.names", ",").alias("names"))


QUERIES = {f.__name__: f for f in (code_symbols, unit_end_rows, heading_symbol_path, code_chunks, remove_overlaps, merge_small_pieces)}


def _symbols_sql(sources: dict) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [f"('{language}', {kind}, {j}, {quoted(symbol)})" for language, own in sources.items() for kind, part in enumerate(own) for j, (_, symbol) in enumerate(part)]
    sizes = [f"('{language}', {len(head)}, {len(part)})" for language, (head, part, _) in sources.items()]
    return f"""
WITH template(language, kind, j, symbol) AS (VALUES {", ".join(rows)}),
sizes(language, n_head, n_part) AS (VALUES {", ".join(sizes)}),
o AS (SELECT o_custkey // {GROUP} AS book, o_orderkey AS k, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey // {GROUP} ORDER BY o_orderkey) - 1 AS nth FROM orders),
b AS (SELECT book, count(*) AS n FROM o GROUP BY book),
told AS (
  SELECT language, book, j AS i, symbol, 0 AS k, '' AS status FROM b, template WHERE kind = 0
  UNION ALL SELECT language, book, n_head + nth * n_part + j, symbol, k, status FROM o, template JOIN sizes USING (language) WHERE kind = 1
  UNION ALL SELECT language, book, n_head + n * n_part + j, symbol, 0, '' FROM b, template JOIN sizes USING (language) WHERE kind = 2)
SELECT language || '-' || book AS id, CAST(i AS INTEGER) AS i, replace(replace(replace(symbol, '{{b}}', book::VARCHAR), '{{k}}', k::VARCHAR), '{{s}}', status) AS symbol FROM told"""


def _merge_sql(pieces: str, key: str) -> str:
    """CTEs that fold ``pieces`` (key, i from 1, f, l, s, e, names) into ``merged`` (key, ordinal, p)."""
    union = lambda a, b: f"struct_pack(f := {a}.f, l := {b}.l, s := {a}.s, e := {b}.e, names := CASE WHEN len({b}.names) > len({a}.names) THEN {b}.names ELSE {a}.names END)"
    put = f"CASE WHEN len(done) > 0 AND op.e - op.s < {CONFIG.min_chars} AND op.e - done[-1].s <= {CONFIG.max_chars} THEN list_append(done[1:len(done) - 1], {union('done[-1]', 'op')}) ELSE list_append(done, op) END"
    return f"""
q AS (SELECT {key}, i, struct_pack(f := f, l := l, s := s, e := e, names := names) AS p FROM {pieces}),
fold AS (
  SELECT {key}, 1 AS i, list_filter([p], lambda x: false) AS done, p AS op FROM q WHERE i = 1
  UNION ALL
  SELECT {key}, i + 1, CASE WHEN grows THEN done ELSE {put} END, CASE WHEN grows THEN {union('op', 'p')} ELSE p END
  FROM (SELECT fold.*, q.p, op.e - op.s < {CONFIG.min_chars} AND q.p.e - op.s <= {CONFIG.max_chars} AS grows FROM fold JOIN q ON q.{key} = fold.{key} AND q.i = fold.i + 1)),
ended AS (SELECT {key}, {put} AS pieces FROM fold WHERE (fold.{key}, fold.i) IN (SELECT {key}, max(i) FROM q GROUP BY {key})),
merged AS (SELECT {key}, unnest(pieces) AS p, generate_subscripts(pieces, 1) - 1 AS ordinal FROM ended)"""


def _code_chunks_sql() -> str:
    """Units of a book: the module's head, the class's head, each order behind a blank line, the module's end.  The
    class's units are packed side by side, the module's head goes with the first piece, and small pieces merge."""
    head, part, foot = SOURCES["python"]
    text = lambda lines: "'" + "\n".join(line for line, _ in lines).replace("'", "''") + "'"
    filled = lambda lines: f"replace(replace(replace({text(lines)}, '{{b}}', book::VARCHAR), '{{k}}', k::VARCHAR), '{{s}}', status)"
    inner = [line for line in part if line[1] != "Book_{b}"]  # what is inside the order's own section
    head_module = head[:5]
    return f"""
WITH RECURSIVE
o AS (SELECT o_custkey // {GROUP} AS book, o_orderkey AS k, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey // {GROUP} ORDER BY o_orderkey) AS nth FROM orders),
n AS (SELECT book, count(*) AS n FROM o GROUP BY book),
unit AS (  -- of the class: (place, first line, lines, size, names)
  SELECT book, 0 AS u, {len(head_module)} AS f, {len(head) - len(head_module) + 1} AS h, length(replace({text(head[5:])}, '{{b}}', book::VARCHAR)) + 2 AS size, ['Book_' || book] AS names, false AS own FROM n
  UNION ALL SELECT book, 2 * nth - 1, {len(head) + 1} + (nth - 1) * {len(part)}, {len(inner)}, length({filled(inner)}) + 1, ['Book_' || book, 'order_' || k], true FROM o
  UNION ALL SELECT book, 2 * nth, {len(head)} + nth * {len(part)}, 1, 1, ['Book_' || book], false FROM o JOIN n USING (book) WHERE nth < n),
sized AS (SELECT *, (sum(size) OVER (PARTITION BY book ORDER BY u))::BIGINT AS e FROM unit),
run AS (
  SELECT book, u, 0 AS piece, size AS held FROM sized WHERE u = 0
  UNION ALL
  SELECT sized.book, sized.u, CASE WHEN held + size <= {CONFIG.max_chars} THEN piece ELSE piece + 1 END, CASE WHEN held + size <= {CONFIG.max_chars} THEN held + size ELSE size END
  FROM run JOIN sized ON sized.book = run.book AND sized.u = run.u + 1),
start AS (SELECT book, length(replace({text(head_module)}, '{{b}}', book::VARCHAR)) + 1 AS size FROM n),
ending AS (SELECT book, length(replace({text(foot[2:])}, '{{b}}', book::VARCHAR)) + 1 AS size FROM n),
packed AS (  -- blank lines at the edges of a piece are trimmed
  SELECT book, piece + 1 AS i, CASE WHEN piece = 0 THEN 0 ELSE min(f) FILTER (sized.size > 1) END AS f, max(f + h - CASE WHEN u = 0 THEN 2 ELSE 1 END) FILTER (sized.size > 1) AS l,
    CASE WHEN piece = 0 THEN 0 ELSE min(start.size + e - sized.size) FILTER (sized.size > 1) END AS s, max(start.size + e - CASE WHEN u = 0 THEN 1 ELSE 0 END) FILTER (sized.size > 1) AS e,
    CASE WHEN piece = 0 THEN ['Book_' || book] ELSE arg_min(names, u) FILTER (own) END AS names
  FROM run JOIN sized USING (book, u) JOIN start USING (book) GROUP BY book, piece
  UNION ALL
  SELECT book, (SELECT max(piece) FROM run r WHERE r.book = n.book) + 2, {len(head)} + n * {len(part)} + 2, {len(head)} + n * {len(part)} + {len(foot) - 1}, start.size + c.e + 2, start.size + c.e + 2 + ending.size, []
  FROM n JOIN start USING (book) JOIN ending USING (book) JOIN (SELECT book, max(e)::BIGINT AS e FROM sized GROUP BY book) c USING (book)),
small AS (SELECT book FROM packed GROUP BY book HAVING max(e) <= {CONFIG.max_chars}),
{_merge_sql("packed", "book")}
SELECT 'python-' || book AS id, CAST(ordinal AS INTEGER) AS ordinal, CAST(p.f + 1 AS INTEGER) AS start_line, CAST(p.l + 1 AS INTEGER) AS end_line, array_to_string(p.names, ' > ') AS symbol, CAST(p.e - p.s - 1 AS INTEGER) AS n_chars
FROM merged WHERE book NOT IN (FROM small)
UNION ALL SELECT 'python-' || book, 0, 1, CAST(max(l) + 1 AS INTEGER), 'Book_' || book, CAST(max(e) - 1 AS INTEGER) FROM packed WHERE book IN (FROM small) GROUP BY book"""


ORACLES = {
    "code_symbols": _symbols_sql(SOURCES),
    "unit_end_rows": f"SELECT id, symbol, min(i) AS first_row, max(i) AS end_row FROM ({_symbols_sql(SOURCES)}) WHERE symbol <> '' GROUP BY id, symbol",
    "heading_symbol_path": _symbols_sql(HEADINGS),
    "code_chunks": _code_chunks_sql(),
    "remove_overlaps": _WINDOWS_SQL
    + r""",
pushed AS (SELECT doc_id, greatest(a, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1) AS a, b FROM c)
SELECT p.doc_id, CAST(min(e.i) AS INTEGER) AS first, CAST(max(e.i) AS INTEGER) AS last FROM pushed p JOIN e ON e.doc_id = p.doc_id AND e.i BETWEEN p.a AND p.b
WHERE regexp_replace(e.line, '[\s\x0b\x1c-\x1f\x{85}\x{a0}]+', '', 'g') <> '' GROUP BY p.doc_id, p.a, p.b""",
    "merge_small_pieces": _WINDOWS_SQL
    + f""",
lines AS (SELECT doc_id, i + 1 AS i, i AS f, i AS l, end_size - size AS s, end_size AS e, CASE WHEN size % 3 = 0 THEN ['line', i::VARCHAR] ELSE ['line'] END AS names FROM e),
{_merge_sql("lines", "doc_id")}
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(p.f AS INTEGER) AS first, CAST(p.l AS INTEGER) AS last, array_to_string(p.names, ',') AS names FROM merged""",
}

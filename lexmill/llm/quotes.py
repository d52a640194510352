"""Quotation linking of message threads (DataFrame operations only).

A line that opens with ``>`` marks is quoted, as deep as it has marks.  Neighbouring lines of one
depth are a passage.  Every message also offers its own words as passages: its whole unquoted
text, each run of its unquoted lines, each of its paragraphs, each sentence, and each line.
Passages are normalised (lower case, white space runs to one space) and hashed; a quoted passage
links to the earliest earlier message of the same conversation that has it as its own.  Where the
whole passage is nobody's, it is cut at blank quoted lines, and each paragraph links by itself:
whole, or else by its sentences, or else by its lines; the latest of these messages counts.

The parent of a message is the latest message that its shallowest linked passages come from.
Messages without a linked quotation open a thread.  A conversation without quotations is the
messages' own text (unquoted lines) by ``position``: every branch under the message it replies to.

Hot conversations and frequent passages: passages are aggregated to their earliest turn before
anything is joined, so a passage costs one row for each conversation, and the roots are found
by doubling steps over the replies only.

Defined cases: a null text has no passages and an empty own text; a message whose conversation
or turn is null links to nothing and has no position; rows of the same conversation and turn share one parent and one position; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import SALTS, drop_table, materialize, table, tasks_for, text_or_empty

#: A line's marks: ``>`` signs with single blanks between or before them.
MARKS = r"^[ \t]?(?:>[ \t]?)+"
PARAGRAPH_BREAK = r"\n[ \t]*\n"
#: In normalised text: the space after a sentence's last sign and what closes with it.
SENTENCE_BREAK = r"(?<=[.!?…][\"'”’»)\]]{0,2}) "
KEY = ["conv_id", "turn"]
#: Ids of conversations that are broadcast at most.
BROADCAST_ROWS = 500_000


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{a0}]+", " "))


def passage_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def sentences(text: Column) -> Column:
    return F.split(normalized(text), SENTENCE_BREAK)


def line_depths(text: Column) -> Column:
    """An array of (depth, line without marks, is blank) for a column of texts."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")

    def parted(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        bare = F.substring(line, F.length(marks) + 1, F.length(line))
        return F.struct(F.length(F.regexp_replace(marks, r"[^>]", "")).alias("depth"), bare.alias("line"), (F.trim(bare) == "").alias("blank"))

    return F.transform(lines, parted)


def _with_runs(messages: DataFrame) -> DataFrame:
    """Adds ``runs``: neighbouring lines of one depth, as an array of (depth, lines); linear in the lines."""
    at, depth = F.col("all_lines.line"), F.col("all_lines.depth")
    opens = lambda i: (i == 0) | (F.get(depth, i) != F.get(depth, i - 1))
    starts = F.filter(F.sequence(F.lit(0), F.size("all_lines") - 1), opens)

    def run(start: Column, n: Column) -> Column:
        end = F.coalesce(F.get("starts", n + 1), F.size("all_lines"))
        return F.struct(F.get(depth, start).cast("int").alias("depth"), F.slice(at, start + 1, end - start).alias("lines"))

    return messages.withColumn("starts", starts).withColumn("runs", F.transform("starts", run)).drop("starts")


def _own_passages(runs: Column) -> Column:
    """What a message says itself: the whole, each run, each paragraph, each sentence and each line."""
    own = F.filter(runs, lambda r: r.depth == 0)
    joined = F.transform(own, lambda r: F.array_join(r.lines, "\n"))
    paragraphs = F.flatten(F.transform(joined, lambda t: F.split(t, PARAGRAPH_BREAK)))
    lines = F.flatten(F.transform(own, lambda r: r.lines))
    passages = F.concat(F.array(F.array_join(joined, "\n")), joined, paragraphs, F.flatten(F.transform(paragraphs, sentences)), lines)
    return F.array_distinct(F.filter(F.transform(passages, normalized), lambda t: t != ""))


def _parsed(messages: DataFrame) -> DataFrame:
    quoting = text_or_empty().rlike(r"(?m)^[ \t]?>")
    lines = F.when(quoting, line_depths(text_or_empty())).otherwise(
        F.transform(F.split(F.regexp_replace(text_or_empty(), "\r\n?", "\n"), "\n"), lambda x: F.struct(F.lit(0).alias("depth"), x.alias("line"), (F.trim(x) == "").alias("blank")))
    )
    return _with_runs(messages.select(*KEY, "role", lines.alias("all_lines"), quoting.alias("quoting"))).drop("all_lines")


def _quoted(parsed: DataFrame) -> DataFrame:
    """A row for each quoted passage: its place, depth, own hash, its lines' hashes and, for
    each of its paragraphs, the (level, hash) of what it may be known by."""
    runs = parsed.filter("quoting").select(*KEY, F.posexplode(F.filter("runs", lambda r: r.depth > 0)).alias("place", "run"))
    lines = F.filter(F.transform("run.lines", normalized), lambda t: t != "")
    held = runs.select(*KEY, "place", F.col("run.depth").alias("depth"), F.array_join("run.lines", "\n").alias("passage"), lines.alias("lines"))

    def known_by(paragraph: Column) -> Column:
        levels = (F.array(normalized(paragraph)), sentences(paragraph), F.transform(F.split(paragraph, "\n"), normalized))
        pieces = [F.transform(F.filter(texts, lambda t: t != ""), lambda t, n=n: F.struct(F.lit(n).alias("level"), F.sha2(t, 256).alias("hash"))) for n, texts in enumerate(levels)]
        return F.array_distinct(F.concat(*pieces))

    parts = F.transform(F.split("passage", PARAGRAPH_BREAK), known_by)
    return held.filter(F.size("lines") > 0).select(*KEY, "place", "depth", passage_hash(F.col("passage")).alias("hash"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("line_hashes"), parts.alias("parts"))


def quotation_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, place, depth, source_turn): source_turn is null where nothing was found."""
    # Repeated rows quote the same passages: those count once.
    quoted = _quoted(parsed).filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoted = quoted.groupBy(*KEY, "place", "depth", "hash", "line_hashes").agg(F.min("parts").alias("parts")).drop("line_hashes")
    quoted = materialize(quoted.withColumn("n", F.monotonically_increasing_id()), "quoted")
    wanted = quoted.select("conv_id", F.col("hash")).union(quoted.select("conv_id", F.explode(F.flatten("parts")).alias("piece")).select("conv_id", "piece.hash")).distinct()
    offered = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    # Only conversations that hold quotations offer anything.  Their ids are few (counted), or else the join is dealt
    # by turn as well, so that one long conversation is not one task.
    quoting = materialize(wanted.select("conv_id").distinct(), "quoting-conversations")
    if quoting.count() <= BROADCAST_ROWS:
        offered = offered.join(F.broadcast(quoting), "conv_id", "left_semi")
    else:
        salt = F.pmod(F.xxhash64("turn"), F.lit(SALTS))
        salted = quoting.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        offered = offered.withColumn("salt", salt).join(salted, ["conv_id", "salt"], "left_semi").drop("salt")
    first = offered.select(*KEY, F.explode(_own_passages(F.col("runs"))).alias("said")).groupBy("conv_id", F.sha2("said", 256).alias("hash")).agg(F.min("turn").alias("source_turn"))
    first = first.join(wanted, ["conv_id", "hash"], "left_semi")
    earlier = F.when(F.col("source_turn") < F.col("turn"), F.col("source_turn"))
    whole = quoted.join(first, ["conv_id", "hash"], "left").select("n", *KEY, "place", "depth", "parts", earlier.alias("source_turn"))
    whole = materialize(whole, "whole-links")
    run = ["n", *KEY, "place", "depth"]
    pieces = whole.filter(F.col("source_turn").isNull()).select(*run, F.posexplode("parts").alias("part", "pieces"))
    pieces = pieces.select(*run, "part", F.explode("pieces").alias("piece")).select(*run, "part", "piece.level", "piece.hash")
    # Of each paragraph the first level that links anything, and of that the latest message.
    nearest = F.max(F.when(earlier.isNotNull(), F.struct((-F.col("level")).alias("nearest"), "source_turn"))).alias("best")
    by_part = pieces.join(first, ["conv_id", "hash"], "left").groupBy(*run, "part").agg(nearest)
    by_part = by_part.groupBy(*run).agg(F.max("best.source_turn").alias("source_turn")).drop("n")
    return whole.filter(F.col("source_turn").isNotNull()).select(*KEY, "place", "depth", "source_turn").union(by_part)


def _paths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, path) of the replies: the turns from the root down to the message, by doubling:
    each step looks up the ancestor of the ancestor, so a chain of n replies takes log2(n) steps."""
    now = materialize(parents.select(*KEY, F.col("parent_turn").alias("up"), F.array("parent_turn", "turn").alias("path")), "ancestors")
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next_up"), F.col("path").alias("path_above"))
        joined = now.join(above, ["conv_id", "up"], "left")
        # Both paths hold the message in which they meet.
        longer = F.when(F.col("path_above").isNull(), F.col("path")).otherwise(F.concat("path_above", F.slice("path", 2, F.size("path") - 1)))
        after = materialize(joined.select("conv_id", "turn", F.coalesce("next_up", "up").alias("up"), longer.alias("path"), F.col("next_up").isNotNull().alias("moved")), "ancestors")
        moved = after.filter("moved").limit(1).count()
        drop_table(now)
        now = after
        if not moved:
            return now.select(*KEY, "path")


def _positions(paths: DataFrame) -> DataFrame:
    """(conv_id, turn, path, position): the place of each message in its conversation's reply order, from 1.

    Rows are dealt by ranges of (conv_id, path), so a conversation of any size is spread over tasks; a
    message's place is its row in its range and what the ranges before it have of its conversation."""
    total = paths.count()
    ranged = paths.repartitionByRange(tasks_for(total, 50_000, large=2_000_000), "conv_id", "path").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "reply-order")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("conv_id", "part").orderBy("path")
    placed = ranged.withColumn("within", F.row_number().over(own)).join(offsets, ["conv_id", "part"])
    return placed.select(*KEY, "path", (F.col("before") + F.col("within")).alias("position"))


def linked_conversations(messages: DataFrame) -> DataFrame:
    """Per message (conv_id, turn, role, text): the same keys with own_text (without quotations),
    n_quoted, n_linked, parent_turn, root_turn, depth, reply_path and position.

    In the order (conv_id, position) the rows are the conversations in reply order: each message
    comes after its parent and before its parent's later replies, with all that replies to it.
    ``reply_path``, the turns from the root to the message, sorts the same way."""
    parsed = materialize(_parsed(messages.select(*KEY, "role", "text")), "parsed-messages")
    links = materialize(quotation_links(parsed), "links")
    linked = links.filter(F.col("source_turn").isNotNull())
    counts = links.groupBy(*KEY).agg(F.count("*").alias("n_quoted"), F.count("source_turn").alias("n_linked"))
    shallowest = linked.groupBy(*KEY).agg(F.max(F.struct((-F.col("depth")).alias("nearest"), F.col("source_turn").alias("parent_turn"))).alias("best")).select(*KEY, "best.parent_turn")
    parents = materialize(shallowest, "parents")
    replies = counts.join(parents, KEY, "left").join(materialize(_paths(parents), "reply-paths"), KEY, "left")
    keys = parsed.select(*KEY).filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).distinct()
    known = materialize(keys.join(replies, KEY, "left").withColumn("path", F.coalesce("path", F.array("turn"))), "replies")
    placed = known.join(_positions(known.select(*KEY, "path")).drop("path"), KEY)
    own = F.array_join(F.flatten(F.transform(F.filter("runs", lambda r: r.depth == 0), lambda r: r.lines)), "\n")
    text = parsed.select(*KEY, "role", F.trim(own).alias("own_text"))
    zero = F.lit(0).cast("long")
    # Rows without a key have no partner: they are not dealt by it.
    keyed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = text.filter(keyed).join(placed, KEY, "left").unionByName(text.filter(~keyed), allowMissingColumns=True)
    return rows.select(
        *KEY, "role", "own_text", F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"), "parent_turn",
        F.coalesce(F.get("path", F.lit(0)), "turn").alias("root_turn"), (F.coalesce(F.size("path"), F.lit(1)) - 1).cast("long").alias("depth"), F.col("path").alias("reply_path"), "position",
    )


def as_rows(messages: DataFrame) -> DataFrame:
    """``linked_conversations`` with the path as text."""
    linked = linked_conversations(messages)
    return linked.withColumn("reply_path", F.array_join(F.transform("reply_path", lambda t: t.cast("string")), "/"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_rows(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH RECURSIVE
m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM conversations),
l AS (SELECT id, conv_id, turn, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS raw FROM m),
d AS (
  SELECT id, conv_id, turn, i, length(regexp_replace(marks, '[^>]', '', 'g')) AS depth, substr(raw, length(marks) + 1) AS line
  FROM (SELECT *, regexp_extract(raw, '^[ \t]?(?:>[ \t]?)+') AS marks FROM l)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, CASE WHEN depth = lag(depth) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS opens FROM d)),
r AS (SELECT id, conv_id, turn, run, any_value(depth) AS depth, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY id, conv_id, turn, run),
o AS (SELECT id, conv_id, turn, string_agg(body, chr(10) ORDER BY run) AS body FROM r WHERE depth = 0 GROUP BY id, conv_id, turn),
op AS (SELECT conv_id, turn, unnest(regexp_split_to_array(body, '\n[ \t]*\n')) AS body FROM r WHERE depth = 0),
said AS (
  SELECT conv_id, turn, body FROM o UNION ALL SELECT conv_id, turn, body FROM r WHERE depth = 0 UNION ALL SELECT conv_id, turn, body FROM op
  UNION ALL SELECT conv_id, turn, unnest(string_split(regexp_replace(trim(regexp_replace(lower(body), '[\s\x0b\x{a0}]+', ' ', 'g')), '([.!?…]["''”’»)\]]{0,2}) ', '\1' || chr(1), 'g'), chr(1))) FROM op UNION ALL SELECT conv_id, turn, line FROM g WHERE depth = 0),
f AS (SELECT conv_id, h, min(turn) AS source FROM (SELECT conv_id, turn, trim(regexp_replace(lower(body), '[\s\x0b\x{a0}]+', ' ', 'g')) AS h FROM said) WHERE h <> '' AND turn IS NOT NULL GROUP BY conv_id, h),
q0 AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY id ORDER BY run) AS place, depth, body, trim(regexp_replace(lower(body), '[\s\x0b\x{a0}]+', ' ', 'g')) AS h,
    list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(lower(x), '[\s\x0b\x{a0}]+', ' ', 'g'))), lambda x: x <> '') AS own_lines
  FROM r WHERE depth > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
q AS (SELECT row_number() OVER () AS n, * FROM (SELECT conv_id, turn, place, depth, h, min(body) AS body FROM q0 WHERE len(own_lines) > 0 GROUP BY conv_id, turn, place, depth, h, own_lines)),
w AS (SELECT q.*, CASE WHEN f.source < q.turn THEN f.source END AS whole FROM q LEFT JOIN f ON f.conv_id = q.conv_id AND f.h = q.h),
qp AS (SELECT n, conv_id, turn, generate_subscripts(ps, 1) AS part, unnest(ps) AS p FROM (SELECT *, regexp_split_to_array(body, '\n[ \t]*\n') AS ps FROM w WHERE whole IS NULL)),
pieces AS (  -- a paragraph, its sentences, its lines
  SELECT n, conv_id, turn, part, 0 AS level, trim(regexp_replace(lower(p), '[\s\x0b\x{a0}]+', ' ', 'g')) AS h FROM qp
  UNION ALL SELECT n, conv_id, turn, part, 1, unnest(string_split(regexp_replace(trim(regexp_replace(lower(p), '[\s\x0b\x{a0}]+', ' ', 'g')), '([.!?…]["''”’»)\]]{0,2}) ', '\1' || chr(1), 'g'), chr(1))) FROM qp
  UNION ALL SELECT n, conv_id, turn, part, 2, trim(regexp_replace(lower(x), '[\s\x0b\x{a0}]+', ' ', 'g')) FROM (SELECT *, unnest(string_split(p, chr(10))) AS x FROM qp)),
levels AS (SELECT pieces.n, part, level, max(f.source) AS source FROM pieces JOIN f ON f.conv_id = pieces.conv_id AND f.h = pieces.h WHERE f.source < pieces.turn GROUP BY pieces.n, part, level),
s AS (SELECT n, max(source) AS part FROM (SELECT n, part, arg_min(source, level) AS source FROM levels GROUP BY n, part) GROUP BY n),
k AS (SELECT conv_id, turn, depth, coalesce(whole, part) AS source FROM w LEFT JOIN s USING (n)),
c AS (SELECT conv_id, turn, count(*) AS n_quoted, count(source) AS n_linked, arg_max(source, (-depth, source)) FILTER (WHERE source IS NOT NULL) AS parent FROM k GROUP BY conv_id, turn),
u AS (
  SELECT conv_id, turn, parent AS up, [parent, turn] AS path FROM c WHERE parent IS NOT NULL
  UNION ALL SELECT u.conv_id, u.turn, c.parent, list_prepend(c.parent, u.path) FROM u JOIN c ON c.conv_id = u.conv_id AND c.turn = u.up WHERE c.parent IS NOT NULL),
t AS (SELECT conv_id, turn, arg_max(path, len(path)) AS path FROM u GROUP BY conv_id, turn),
y AS (SELECT k.conv_id, k.turn, coalesce(t.path, [k.turn]) AS path FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL) k LEFT JOIN t USING (conv_id, turn)),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS position FROM y)
SELECT m.conv_id, m.turn, m.role, trim(coalesce(o.body, '')) AS own_text, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked, c.parent AS parent_turn, coalesce(z.path[1], m.turn) AS root_turn,
  CAST(coalesce(len(z.path), 1) - 1 AS BIGINT) AS depth, array_to_string(z.path, '/') AS reply_path, z.position
FROM m LEFT JOIN o USING (id) LEFT JOIN c ON c.conv_id = m.conv_id AND c.turn = m.turn LEFT JOIN z ON z.conv_id = m.conv_id AND z.turn = m.turn
"""

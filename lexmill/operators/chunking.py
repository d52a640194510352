"""Documents into chunks of whole lines that can be cited exactly.

``chunk_documents`` splits a document where its structure says so (headings, definitions, keys:
``outline``), packs what is small, merges what is too small and cuts what is too large into overlapping windows of
lines; a document of any other language is cut into windows alone.  It is one pass over the
documents without a shuffle.  Python only finds line numbers; what is done with pieces after that
(overlaps, merging, texts) are folds over arrays of structs, which serve any table that has some.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.languages import SYNTAX_LANGUAGES
from lexmill.functions.text import is_blank, split_lines
from lexmill.operators.outline import Section, innermost, outline_of, split_text
from lexmill.operators.slices import sliced

#: A piece of a document: lines (0-based, inclusive), sizes up to its start and its end, the names over it.
PIECE = "struct<first:int,last:int,start_at:long,end_at:long,names:array<string>>"
ARROW_PIECES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start_at", pa.int64()), ("end_at", pa.int64()), ("names", pa.list_(pa.string()))]))


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int = 1800
    min_chars: int = 300
    overlap_lines: int = 3


@dataclass(frozen=True)
class Piece:
    """Lines ``first`` to ``last`` (0-based, inclusive) under a chain of names."""

    first: int
    last: int
    names: tuple[str, ...] = ()


# ---------------------------------------------------------------- per document


def source_of(text: str) -> str:
    """The text with its lines parted by ``\\n``, none behind the last one."""
    return text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n")


def lines_of(text: str) -> list[str]:
    return source_of(text).split("\n") if text else []


def line_windows(ends: Sequence[int], first: int, last: int, config: ChunkConfig) -> Iterator[tuple[int, int]]:
    """Greedy windows over lines ``first`` to ``last``; ``ends[i]`` is the size of lines 0 to i,
    each with its newline.  A longer line than a window may be is a window of its own."""
    while True:
        room = config.max_chars + (ends[first - 1] if first else 0)
        end = min(max(first, bisect_right(ends, room) - 1), last)
        yield first, end
        if end >= last:
            return
        first = max(end + 1 - config.overlap_lines, first + 1)


def _parts(section: Section) -> list[tuple[Section, bool]]:
    """The sections inside and the lines between them, in order, and which of them have a name of their own."""
    out, at = [], section.first
    for inner in [*section.inner, None]:
        end = inner.first - 1 if inner else section.last
        if end >= at:
            out.append((Section(at, end, section.names), False))
        if inner:
            out.append((inner, True))
            at = inner.last + 1
    return out


def split(section: Section, ends: Sequence[int], config: ChunkConfig) -> list[Piece]:
    """Pieces of a section: itself if it fits, else its parts, as many side by side to a piece as fit; a
    part that doesn't fit alone is split the same way, and takes in the small piece right before it."""
    before = lambda line: ends[line - 1] if line else 0
    if ends[section.last] - before(section.first) <= config.max_chars:
        first_inside = section.inner[0].names if section.inner and not section.names else ()
        return [Piece(section.first, section.last, section.names or first_inside)]
    if not section.inner:
        return [Piece(a, b, section.names) for a, b in line_windows(ends, section.first, section.last, config)]
    parts = _parts(section)
    closing = [ends[part.last] for part, _ in parts]
    out, at, packed = [], 0, False
    while at < len(parts):
        upto = bisect_right(closing, config.max_chars + before(parts[at][0].first), lo=at)
        together = parts[at:upto]
        if together:
            names = next((part.names for part, own in together if own), section.names)
            out.append(Piece(together[0][0].first, together[-1][0].last, names))
        else:
            body = split(parts[at][0], ends, config)
            if packed and ends[out[-1].last] - before(out[-1].first) < config.min_chars:
                body[0] = Piece(out.pop().first, body[0].last, body[0].names)
            out += body
        at, packed = max(upto, at + 1), bool(together)
    out[0] = Piece(out[0].first, out[0].last, section.names or out[0].names)
    return out


def pieces_of(text: str | None, language: str | None, config: ChunkConfig) -> list[dict]:
    """What a document is cut into: first and last line (neither is blank), the sizes of all lines before
    the piece and up to its end, and the names over it.  Pieces of structured languages don't overlap."""
    source = source_of(text or "")
    # Arrays, and no list of lines: a long text's would be many times its size.
    filled = array("q", (i for i, line in enumerate(split_text(source)) if line and not line.isspace()))
    if not filled:
        return []
    ends = array("q", accumulate(len(line) + 1 for line in split_text(source)))
    structured = language in SYNTAX_LANGUAGES
    if structured:
        cut = split(outline_of(source, language), ends, config)
    else:
        cut = [Piece(a, b) for a, b in line_windows(ends, 0, len(ends) - 1, config)]
    out, last = [], -1
    for piece in cut:
        # Windows inside a section overlap; each begins behind the one before it.
        start = max(piece.first, last + 1) if structured else piece.first
        a, b = bisect_left(filled, start), bisect_right(filled, piece.last) - 1
        if a <= b:
            first, last = filled[a], filled[b]
            out.append({"first": first, "last": last, "start_at": ends[first - 1] if first else 0, "end_at": ends[last], "names": list(piece.names)})
    return out


# ---------------------------------------------------------------- folds over pieces


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_overlaps(pieces: Column) -> Column:
    """Pieces (structs with first and last) in order, each pushed past the end of those before it, if
    anything is left of it."""
    shape = "array<struct<first:int,last:int>>"
    plain = F.array_sort(F.transform(pieces, lambda p: F.struct(p["first"].cast("int").alias("first"), p["last"].cast("int").alias("last"))))
    start = F.struct(F.array().cast(shape).alias("done"), F.lit(-1).alias("end"))

    def step(state: Column, piece: Column) -> Column:
        rest = F.struct(F.greatest(piece["first"], state["end"] + 1).alias("first"), piece["last"].alias("last"))
        more = piece["last"] > state["end"]
        return F.struct(F.when(more, F.concat(state["done"], F.array(rest))).otherwise(state["done"]).alias("done"), F.greatest(state["end"], piece["last"]).alias("end"))

    return F.aggregate(plain, start, step, lambda state: state["done"])


def trimmed(pieces: Column, lines: Column) -> Column:
    """Pieces (first, last) without the blank lines at either edge, none of them blank."""

    def trim(piece: Column) -> Column:
        filled = F.transform(F.slice(lines, piece["first"] + 1, piece["last"] - piece["first"] + 1), lambda line: ~is_blank(line))
        return _let(filled, lambda own: F.struct((piece["first"] + F.array_position(own, True).cast("int") - 1).alias("first"), (piece["last"] + 1 - F.array_position(F.reverse(own), True).cast("int")).alias("last"), F.array_contains(own, True).alias("filled")))

    kept = F.filter(F.transform(pieces, trim), lambda p: p["filled"])
    return F.transform(kept, lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last")))


def merged_small(pieces: Column, config: ChunkConfig) -> Column:
    """Pieces (``PIECE``) in order: one under the least size takes in those after it while the union fits; if it
    stays too small it joins the piece before it, if that fits.  The deeper names win, of equals the earlier."""
    size = lambda p: p["end_at"] - p["start_at"]

    def union(a: Column, b: Column) -> Column:
        names = F.when(F.size(b["names"]) > F.size(a["names"]), b["names"]).otherwise(a["names"])
        return F.struct(a["first"].alias("first"), b["last"].alias("last"), a["start_at"].alias("start_at"), b["end_at"].alias("end_at"), names.alias("names"))

    fits = lambda a, b: b["end_at"] - a["start_at"] <= config.max_chars

    def put(done: Column, piece: Column) -> Column:
        joins = (size(piece) < config.min_chars) & (F.size(done) > 0) & fits(F.element_at(done, -1), piece)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(union(F.element_at(done, -1), piece)))
        return F.when(F.coalesce(joins, F.lit(False)), joined).otherwise(F.concat(done, F.array(piece)))

    start = F.struct(F.array().cast(f"array<{PIECE}>").alias("done"), F.lit(None).cast(PIECE).alias("open"))

    def step(state: Column, piece: Column) -> Column:
        held = state["open"]
        grows = held.isNotNull() & (size(held) < config.min_chars) & fits(held, piece)
        done = F.when(held.isNull() | grows, state["done"]).otherwise(put(state["done"], held))
        return F.struct(done.alias("done"), F.when(grows, union(held, piece)).otherwise(piece).alias("open"))

    return F.aggregate(pieces, start, step, lambda state: F.when(state["open"].isNull(), state["done"]).otherwise(put(state["done"], state["open"])))


# ---------------------------------------------------------------- DataFrames


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[str | None, str | None]]:
    """The texts of a batch, one at a time, with their languages."""
    return zip((t.as_py() for t in batch.column("text")), batch.column("language").to_pylist())


def pieces_column(text: Column, language: Column, config: ChunkConfig) -> Column:
    """The pieces (``PIECE``) of each document, as its structure says."""

    @F.arrow_udf(f"array<{PIECE}>")
    def cut(texts: pa.Array, languages: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([texts, languages], names=["text", "language"])
        told = [pa.array([pieces_of(t, own, config) for t, own in _documents(part)], ARROW_PIECES) for part in sliced(whole, "text")]
        return pa.concat_arrays(told)

    return cut(text, language)


def chunk_documents(docs: DataFrame, key: str, config: ChunkConfig = ChunkConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, ordinal, start_line, end_line, symbol, text) for documents (key, text, language), and their columns ``carry``."""
    pieces = docs.select(key, *carry, F.coalesce("text", F.lit("")).alias("text"), "language", pieces_column(F.col("text"), F.col("language"), config).alias("pieces"))
    merged = F.when(F.col("language").isin(*SYNTAX_LANGUAGES), merged_small(F.col("pieces"), config)).otherwise(F.col("pieces"))

    def told(lines: Column) -> Column:
        body = lambda p: F.array_join(F.slice(lines, p["first"] + 1, p["last"] - p["first"] + 1), "\n")
        return F.transform(merged, lambda p: F.struct((p["first"] + 1).alias("start_line"), (p["last"] + 1).alias("end_line"), F.array_join(p["names"], " > ").alias("symbol"), body(p).alias("text")))

    chunks = pieces.select(key, *carry, _let(split_lines(F.col("text")), told).alias("chunks"))
    # Of a plain explode Spark infers a filter on the array, below it, and so has Python cut every document twice.
    each = chunks.select(key, *carry, F.posexplode_outer("chunks").alias("ordinal", "chunk")).filter(F.col("chunk").isNotNull())
    return each.select(key, "ordinal", "chunk.*", *carry)


def _named_lines(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    """For each document of a batch: the number of the innermost section of each line, and what the sections are called."""
    for text, language in _documents(part):
        which, names = innermost(source_of(text), language) if text and language in SYNTAX_LANGUAGES else (np.zeros(0, np.int32), [])
        yield which, [" > ".join(n) for n in names]


def _of_documents(docs: DataFrame, key: str, columns: str, rows: Callable[[pa.RecordBatch], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """(key, ``columns``): rows of documents (key, text, language).  ``rows`` tells of a few documents the place of each
    row's document, and the columns."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                place, own = rows(part)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(place)), *own], names=names)

    return docs.select(key, "text", "language").mapInArrow(run, schema)


def line_symbols(docs: DataFrame, key: str) -> DataFrame:
    """(key, i, symbol): the names of the innermost section over each line of documents (key, text, language)."""

    def rows(part: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        sizes, numbers, known = [], [np.zeros(0, np.int32)], []
        for which, names in _named_lines(part):
            sizes.append(len(which))
            numbers.append(which + np.int32(len(known)))
            known += names
        i = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in sizes)])
        return np.repeat(np.arange(len(sizes)), sizes), [pa.array(i), pa.array(known, pa.string()).take(pa.array(np.concatenate(numbers)))]

    return _of_documents(docs, key, "i int, symbol string", rows)


def unit_rows(docs: DataFrame, key: str) -> DataFrame:
    """(key, symbol, first_row, end_row): the first and the last line over which each named section of documents (key,
    text, language; a row for each) is the innermost one; sections of one name count as one."""

    def rows(part: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        place, told, first, end = [], [], [], []
        for number, (which, names) in enumerate(_named_lines(part)):
            starts = np.flatnonzero(np.diff(which, prepend=-1))
            ends = [*(starts[1:] - 1).tolist(), len(which) - 1]
            at: dict[str, list[int]] = {}
            for k, a, b in zip(which[starts].tolist(), starts.tolist(), ends):
                if names[k]:
                    at.setdefault(names[k], [a, b])[1] = b
            place += [number] * len(at)
            told += at
            first += [a for a, _ in at.values()]
            end += [b for _, b in at.values()]
        return np.array(place, np.int64), [pa.array(told, pa.string()), pa.array(first, pa.int32()), pa.array(end, pa.int32())]

    return _of_documents(docs, key, "symbol string, first_row int, end_row int", rows)


def exploded_lines(docs: DataFrame, key: str) -> DataFrame:
    """(key, i, line): the lines of each document, numbered from 0."""
    return docs.select(key, F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("i", "line"))


def line_ends(lines: DataFrame, key: str) -> DataFrame:
    """Running size of each document's lines, every line with its newline."""
    order = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.select(key, "i", (F.length("line") + 1).alias("size"), F.sum(F.length("line") + 1).over(order).alias("end_size"))


def heading_paths(lines: DataFrame, key: str, levels: int = 6) -> DataFrame:
    """The chain of Markdown headings over each line, by windows."""
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    title = F.trim(F.regexp_replace("line", r"^#+\s+|\s*#*\s*$", ""))
    order = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lines.withColumn("level", marks).withColumn("title", F.when(F.col("level") > 0, title))
    # A heading closes all deeper ones: a level counts while nothing higher has come since.
    at = {n: F.last(F.when(F.col("level") == n, F.col("i")), ignorenulls=True).over(order) for n in range(1, levels + 1)}
    name = {n: F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(order) for n in range(1, levels + 1)}
    for n in range(1, levels + 1):
        out = out.withColumn(f"at{n}", at[n]).withColumn(f"name{n}", name[n])
    parts: list[Column] = []
    for n in range(1, levels + 1):
        higher = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"at{m}"), F.lit(-1)) for m in range(1, n))) if n > 1 else F.lit(-1)
        parts.append(F.when(F.col(f"at{n}") > higher, F.col(f"name{n}")))
    return out.select(key, "i", "line", F.concat_ws(" > ", *parts).alias("symbol"))


def filled_documents(docs: DataFrame) -> DataFrame:
    """Documents with at least one line that is not blank."""
    return docs.filter(~is_blank(F.coalesce("text", F.lit(""))))

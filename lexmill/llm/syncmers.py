"""Document fingerprints from closed syncmers (DataFrame operations only).

A k-mer of a text's UTF-8 bytes is an anchor when the smallest of its s-mers (by hash) is its
first or its last.  That depends on the k-mer alone, so equal passages have equal anchors
wherever they stand, and a text can be cut anywhere as long as the cuts overlap by k - 1 bytes.

The fingerprint is the sketch of the ``SKETCH`` smallest distinct 32-bit hashes of the anchors
(a text without any anchor: the hash of the whole text); the likeness of two fingerprints is
the Jaccard index of their anchors as estimated from the sketches, and is exact while a text
has no more anchors than the sketch holds.

``with_edits`` puts each document beside the next in descending doc_id order.  Documents are
dealt into ranges of ids of about ``RANGE_BYTES`` (up to a gigabyte once there are thousands of them); the first document of a range also visits
the range before it (and the first of all the last), so a window inside each range sees every
neighbour and texts are shuffled once.  Long texts are hashed in segments.

Defined cases: a null text counts as empty; a null doc_id comes last; rows of one id follow
each other by a hash of their text; the only document of a table is its own next.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import materialize, table, tasks_for, text_or_empty

K, S = 12, 5
SKETCH, SEGMENT = 64, 4096
RANGE_BYTES = 4_000_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash32(data: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(data), 32)


def anchor_positions(data: Column, k: int = K, s: int = S) -> Column:
    """0-based byte positions of the closed syncmers of a binary of at least ``k`` bytes."""
    width = k - s + 1
    if width & (width - 1):
        raise ValueError("k - s + 1 must be a power of two")
    n = F.octet_length(data)

    def edges(inner: Column, least: Column) -> Column:
        at_edge = lambda i: (F.get(least, i) == F.get(inner, i)) | (F.get(least, i) == F.get(inner, i + (width - 1)))
        return F.filter(F.sequence(F.lit(0), n - k), at_edge)

    def halved(inner: Column, least: Column, span: int) -> Column:
        """``least[i]`` is the smallest of ``span`` s-mers from ``i`` on; doubled until it is a k-mer's."""
        if span == width:
            return edges(inner, least)
        wider = F.zip_with(least, F.slice(least, span + 1, F.size(least)), lambda x, y: F.least(x, y))
        return _let(wider, lambda w: halved(inner, w, 2 * span))

    inner = F.transform(F.sequence(F.lit(1), n - s + 1), lambda i: F.xxhash64(F.substring(data, i, s)))
    return _let(inner, lambda x: halved(x, x, 1))


def anchor_hashes(data: Column, k: int = K, s: int = S) -> Column:
    none = F.array().cast("array<bigint>")
    found = F.transform(anchor_positions(data, k, s), lambda i: hash32(F.substring(data, i + 1, k)))
    return F.when(F.octet_length(data) >= k, found).otherwise(none)


def _smallest(hashes: Column, size: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, size)


def sketch(data: Column, k: int = K, s: int = S, size: int = SKETCH) -> Column:
    """The smallest anchor hashes of a binary of any length (empty where it has no anchor)."""
    last = F.greatest(F.octet_length(data) - k, F.lit(0))
    starts = F.sequence(F.lit(0), F.floor(last / SEGMENT).cast("int"))
    segments = F.transform(starts, lambda j: _let(F.substring(data, j * SEGMENT + 1, SEGMENT + k - 1), lambda part: _smallest(anchor_hashes(part, k, s), size)))
    return _let(segments, lambda parts: F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(_smallest(F.flatten(parts), size)))


def whole_if_empty(hashes: Column, data: Column) -> Column:
    return F.when(F.size(hashes) > 0, hashes).otherwise(F.array(hash32(data)))


def printed(hashes: Column) -> Column:
    """A fingerprint as text: 8 hex digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """The estimated Jaccard index of the anchors behind two sketches, 0 to 1."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    data = docs.select("doc_id", text_or_empty().cast("binary").alias("data")).withColumn("hashes", sketch(F.col("data")))
    return data.select("doc_id", printed(whole_if_empty(F.col("hashes"), F.col("data"))).alias("fingerprint"))


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, hash): every anchor with its byte position, for positional matching."""
    data = docs.select("doc_id", text_or_empty().cast("binary").alias("data"))
    last = F.greatest(F.octet_length("data") - K, F.lit(0))
    parts = data.select("doc_id", "data", F.explode(F.sequence(F.lit(0), F.floor(last / SEGMENT).cast("int"))).alias("j"))
    parts = parts.select("doc_id", (F.col("j") * SEGMENT).alias("base"), F.substring(F.col("data"), F.col("j") * SEGMENT + 1, F.lit(SEGMENT + K - 1)).alias("part"))
    at = parts.filter(F.octet_length("part") >= K).select("doc_id", "base", "part", F.explode(anchor_positions(F.col("part"))).alias("at"))
    return at.select("doc_id", (F.col("base") + F.col("at")).alias("pos"), F.xxhash64(F.substring(F.col("part"), F.col("at") + 1, F.lit(K))).alias("hash"))


def positional_matches(pairs: DataFrame, anchored: DataFrame, min_anchors: int = 3) -> DataFrame:
    """(left_id, right_id, shift, n_anchors): for given pairs of documents, how many anchors (of
    ``anchors``) they share at one shift of positions.  Anchors that stand more than once in a
    document are not used, so a pair costs no more than the shorter document's anchors."""
    once = anchored.groupBy("doc_id", "hash").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).filter("n = 1")
    left = once.select(F.col("doc_id").alias("left_id"), "hash", F.col("pos").alias("p"))
    right = once.select(F.col("doc_id").alias("right_id"), "hash", F.col("pos").alias("q"))
    shared = pairs.select("left_id", "right_id").distinct().join(left, "left_id").join(right, ["right_id", "hash"])
    return shared.groupBy("left_id", "right_id", (F.col("q") - F.col("p")).alias("shift")).agg(F.count("*").alias("n_anchors")).filter(F.col("n_anchors") >= min_anchors)


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most ``key``: first by runs of cuts, then inside one run."""
    width = max(1, math.isqrt(len(cuts)))
    runs = F.from_json(F.lit(json.dumps([cuts[i : i + width] for i in range(0, len(cuts), width)])), "array<array<bigint>>")
    opened = F.size(F.filter(runs, lambda run: F.get(run, F.lit(0)) <= key))
    inside = F.size(F.filter(F.get(runs, opened - 1), lambda c: c <= key))
    return F.when(opened > 0, (opened - 1) * width + inside).otherwise(0)


def _in_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents with their range of ids, guests included; the number of ranges."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = tasks_for(total, RANGE_BYTES)
    cuts = rows.agg(F.percentile_approx("key", [i / wanted for i in range(1, wanted)] or [0.5], max(1000, 8 * wanted))).first()[0] or []
    # Ranges are numbered downwards, as the documents are ordered.
    ranged = rows.withColumn("id_range", -range_of(F.col("key"), sorted(set(cuts))))
    heads = ranged.groupBy("id_range").agg(F.max(F.struct("key", "tie")).alias("head"))  # a row for each range
    heads = materialize(heads, "range-heads").coalesce(1)
    order = Window.orderBy("id_range")
    visits = F.coalesce(F.lag("id_range").over(order), F.max("id_range").over(Window.partitionBy()))
    heads = heads.select("id_range", "head", visits.alias("visits"))
    head_of = F.broadcast(heads.select(F.col("id_range").alias("id_range"), "head", "visits"))
    is_head = (F.col("head.key") == F.col("key")) & (F.col("head.tie") == F.col("tie"))
    own, guest = F.struct(F.col("id_range"), F.lit(False).alias("guest")), F.struct(F.col("visits").alias("id_range"), F.lit(True).alias("guest"))
    placed = ranged.join(head_of, "id_range").withColumn("seat", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))))
    return placed.select("doc_id", "key", "tie", "text", "seat.id_range", "seat.guest"), wanted


def with_edits(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The edited text is the document with its last third replaced by
    as many characters from the head of the next document."""
    placed, wanted = _in_ranges(docs)
    seated = placed.repartitionByRange(wanted, "id_range")
    order = Window.partitionBy("id_range").orderBy("guest", F.col("key").desc(), F.col("tie").desc())
    n_chars = F.char_length("text")
    third = F.floor(n_chars / 3).cast("int")
    near = seated.select("*", F.lead("text").over(order).alias("next_text"), n_chars.alias("n_chars"))
    cut = near.select(
        "doc_id", "key", "tie", "id_range", "guest", "n_chars", F.col("text").cast("binary").alias("data"),
        F.substring(F.col("text"), F.lit(1), n_chars - third).cast("binary").alias("head"),
        F.coalesce(F.substring(F.col("next_text"), F.lit(1), third), F.lit("")).cast("binary").alias("new_tail"),
    )
    kept = F.octet_length("head")
    overlap = F.greatest(kept - (K - 1), F.lit(0))
    before_cut = F.substring(F.col("head"), overlap + 1, F.lit(K - 1))
    sketched = cut.select(
        "*", sketch(F.col("head")).alias("kept_hashes"),
        sketch(F.substring(F.col("data"), overlap + 1, F.octet_length("data"))).alias("tail_hashes"),
        sketch(F.concat(before_cut, F.col("new_tail"))).alias("new_hashes"),
    )
    edited = F.concat(F.col("head"), F.col("new_tail"))
    merged = sketched.select(
        "doc_id", "key", "tie", "id_range", "guest", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        whole_if_empty(_smallest(F.concat("kept_hashes", "tail_hashes"), SKETCH), F.col("data")).alias("own"),
        whole_if_empty(_smallest(F.concat("kept_hashes", "new_hashes"), SKETCH), edited).alias("changed"),
    )
    beside = merged.select("*", F.lead("own").over(order).alias("next_own")).filter(~F.col("guest"))
    return beside.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))

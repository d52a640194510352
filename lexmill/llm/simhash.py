"""SimHash near-duplicates, compared bit-sliced.

Fingerprints of ``shingle`` words (64 bits, a majority vote over the XXH64 values of all
shingles, repeats included) link when they differ in at most ``radius`` bits.  Equal
fingerprints are one node from the start, so exact copies cost nothing.

Candidates: the 64 bits are four blocks of 16; two fingerprints within two bits agree on
two whole blocks, so each fingerprint goes to the six buckets of its pairs of blocks.  A
bucket of more than ``HOT`` fingerprints is dealt again by two more of the four bytes that
are left (again two bytes must agree), which bounds every group by 2**16 fingerprints
without dropping a pair.

Comparison in a bucket: 64 fingerprints form a block of 64 bit planes (word ``j`` holds bit
``j`` of all 64).  A fingerprint is compared with the whole block at once: the planes where
they differ go into carry-save counters, and a block is abandoned as soon as all its lanes
exceed the radius.  A bucket returns a spanning star of each of its own components, never
all pairs.

Defined cases: null and empty texts have the fingerprint 0 and link like any other; texts of
one or two words are one shingle; repeated rows stay rows of their own; a component is named
by its smallest doc_id (null ids do not name one unless all are null).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexmill.llm.common import hot_keys, join_hot, materialize, table
from lexmill.llm.components import components
from lexmill.llm.words import give_back, slices_of, whole_texts

SEED, SHINGLE, RADIUS = 42, 3, 2
HOT, SLICE_BYTES = 4096, 2_000_000
_BITS = np.arange(64, dtype=np.uint64)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _votes(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes: run ``i`` begins at ``starts[i]``, none is empty."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    totals = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * totals > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> pa.Array:
    """The fingerprint of each text, as a signed 64-bit number; some megabytes of texts at a time."""
    parts = [_fingerprints(texts.slice(first, last - first), shingle) for first, last in slices_of(texts, SLICE_BYTES)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))


def _fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    lowered = pc.ascii_split_whitespace(pc.ascii_lower(whole_texts(texts)))
    out = np.zeros(len(texts), dtype=np.uint64)
    digest, hashes, rows, counts, pending = xxhash.xxh64_intdigest, [], [], [], 0

    def flush() -> None:
        nonlocal pending
        if rows:
            n = np.array(counts)
            out[rows] = _votes(np.array(hashes, dtype=np.uint64), np.cumsum(n) - n, n)
        hashes.clear(), rows.clear(), counts.clear()
        pending = 0

    for i in range(len(texts)):
        words = [w for w in lowered[i].as_py() if w]
        if not words:
            continue
        joined = " ".join(words).encode()
        if len(words) <= shingle:
            own = [digest(joined, SEED)]
        else:
            lengths = np.array([len(w.encode()) for w in words]) if not joined.isascii() else np.array([len(w) for w in words])
            begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
            end = (begin + lengths)[shingle - 1 :].tolist()
            own = [digest(joined[a:b], SEED) for a, b in zip(begin.tolist(), end)]
        hashes.extend(own)
        rows.append(i)
        counts.append(len(own))
        pending += len(own)
        if pending > 50_000:
            flush()
    flush()
    return out.view(np.int64)


@F.arrow_udf(LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    out = fingerprints(texts)
    give_back()
    return out


def fingerprint(text: Column) -> Column:
    return fingerprint_udf(text)


def _exceeds(counters: list[np.ndarray], overflow: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose carry-save counter is over ``radius``, or has overflowed."""
    above, equal = np.zeros_like(overflow), np.full_like(overflow, _ONES)
    for place in reversed(range(len(counters))):
        if radius >> place & 1:
            equal &= counters[place]
        else:
            above |= equal & counters[place]
            equal &= ~counters[place]
    return above | overflow


def bit_planes(values: np.ndarray, group_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertical blocks of at most 64 fingerprints, none over two groups.

    Returns the planes (blocks x 64), the block and the lane of every fingerprint, and the
    mask of the lanes in use in each block."""
    within = np.arange(len(values)) - np.repeat(np.cumsum(group_sizes) - group_sizes, group_sizes)
    blocks_each = -(-group_sizes // 64)
    block = np.repeat(np.cumsum(blocks_each) - blocks_each, group_sizes) + within // 64
    lane = (within % 64).astype(np.uint64)
    firsts = np.flatnonzero(np.diff(block, prepend=-1))
    lanes = ((values[:, None] >> _BITS) & np.uint64(1)) << lane[:, None]
    return np.bitwise_or.reduceat(lanes, firsts, axis=0), block, lane, np.bitwise_or.reduceat(np.uint64(1) << lane, firsts)


def near_pairs(values: np.ndarray, group_sizes: np.ndarray, radius: int, at_once: int = 1 << 20):
    """Yield index arrays (i, j) of the pairs within a group that differ in at most ``radius`` bits."""
    planes, block, lane, used = bit_planes(values, group_sizes)
    blocks_each = -(-group_sizes // 64)
    end_of_group = np.repeat(np.cumsum(blocks_each), group_sizes)
    lane_start = np.flatnonzero(np.diff(block, prepend=-1))
    todo = end_of_group - block  # a fingerprint meets its own block and the later ones of its group
    first = 0
    while first < len(values):
        last = first + max(1, int(np.searchsorted(np.cumsum(todo[first:]), at_once, "right")))
        mine = todo[first:last]
        query = np.repeat(np.arange(first, last), mine)
        met = block[query] + np.arange(len(query)) - np.repeat(np.cumsum(mine) - mine, mine)
        lanes_left = used[met].copy()
        own = met == block[query]
        lanes_left[own] &= ~((np.uint64(2) << lane[query[own]]) - np.uint64(1))  # only later lanes of the own block
        counters = [np.zeros(len(query), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
        overflow = np.zeros(len(query), dtype=np.uint64)
        for j in range(64):
            carry = planes[met, j] ^ (np.uint64(0) - ((values[query] >> np.uint64(j)) & np.uint64(1)))
            for place, held in enumerate(counters):
                counters[place], carry = held ^ carry, held & carry
            overflow |= carry
            if j % 8 == 7:
                lanes_left = lanes_left & ~_exceeds(counters, overflow, radius)
                keep = np.flatnonzero(lanes_left)
                if len(keep) < len(lanes_left):
                    query, met, lanes_left, overflow = query[keep], met[keep], lanes_left[keep], overflow[keep]
                    counters = [c[keep] for c in counters]
                if not len(query):
                    break
        if len(query):
            row, bit = np.nonzero((lanes_left[:, None] >> _BITS) & np.uint64(1))
            yield query[row], lane_start[met[row]] + bit
        first = last


def _spanning_stars(values: np.ndarray, group_sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint with the first of its component within the group."""
    pairs = list(near_pairs(values, group_sizes, radius))
    if not pairs:
        return values[:0], values[:0]
    i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    member = np.flatnonzero(label != np.arange(len(values)))
    return values[member], values[label[member]]


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("fps")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at, done = 0, 0
            while at < len(sizes):  # some 64 Ki fingerprints at a time
                upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 16, "right")))
                n = int(sizes[at:upto].sum())
                u, v = _spanning_stars(values[done : done + n], sizes[at:upto], radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
                at, done = upto, done + n

    return run


def _pair_keys(parts: list[Column]) -> Column:
    """Two of the parts at a time: an array of (which two, their values)."""
    return F.array(*(F.struct(F.lit(n).alias("which"), F.shiftleft(a.cast("long"), 16).bitwiseOR(b.cast("long")).alias("bits")) for n, (a, b) in enumerate(combinations(parts, 2))))


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(u, v): stars over the distinct fingerprints ``fp`` of ``nodes`` that link."""
    if not 0 <= radius <= 2:
        raise ValueError("the bucketing is exact for a radius of 0, 1 or 2")
    blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keyed = nodes.select("fp", F.explode(_pair_keys(blocks)).alias("key")).select("fp", "key.which", "key.bits")
    counted = materialize(keyed.groupBy("which", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    cold = keyed.join(counted.filter(F.col("n") <= hot).drop("n"), ["which", "bits"])
    groups = cold.groupBy("which", "bits").agg(F.collect_list("fp").alias("fps")).select("fps")

    crowded = keyed.join(counted.filter(F.col("n") > hot).drop("n"), ["which", "bits"])
    #: The two blocks that are not in the bucket's key, as four bytes.
    others = [[i for i in range(4) if i not in pair] for pair in combinations(range(4), 2)]
    left = F.element_at(F.array(*(F.array(*(F.shiftrightunsigned("fp", 16 * i + 8 * half).bitwiseAND(0xFF) for i in two for half in (0, 1))) for two in others)), F.col("which") + 1)
    again = crowded.select("fp", "which", "bits", left.alias("bytes"))
    again = again.select("fp", "which", "bits", F.explode(_pair_keys([F.col("bytes")[i] for i in range(4)])).alias("sub"))
    fine = again.groupBy("which", "bits", "sub").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    return groups.union(fine).mapInArrow(_compare(radius), "u long, v long")


def _with_components(nodes: DataFrame, radius: int, hot: int) -> DataFrame:
    """``nodes`` (distinct fingerprints ``fp``) with the fingerprint that stands for their component."""
    linked = components(fingerprint_links(nodes, radius, hot))
    return nodes.join(linked, nodes["fp"] == linked["node"], "left").select(*nodes.columns, F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    own = materialize(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "nodes")
    reach = _with_components(nodes, radius, hot)
    named = reach.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = reach.join(named, "component").select("fp", "component_id")
    # Empty texts, and exact copies, share a fingerprint: rows of the frequent ones are dealt by their ids.
    crowded = hot_keys(nodes, ["fp"], "n", own.count())
    return join_hot(own, by_print, ["fp"], crowded, F.xxhash64("doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _row_hash() -> Column:
    """SHA-256 over a row's id and text (nulls apart from empty ones): rows that share it are the same document."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(part(F.col("doc_id").cast("string")), F.lit("\0"), part(F.col("text"))), 256))


def deduplicated(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """One row of each group, that with the group's smallest doc_id, with all its columns.  A null
    id comes after all others; of rows that share the id, the hash over id and text decides, and
    of rows that share the text as well one stays.  What an id does elsewhere plays no part."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("first")
    own = materialize(docs.select("doc_id", _row_hash().alias("row_hash"), fingerprint(F.col("text")).alias("fp")), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(first), "nodes")
    keep = _with_components(nodes, radius, hot).groupBy("component").agg(F.min("first").alias("first")).select("first.row_hash")
    stays = docs.withColumn("row_hash", _row_hash()).join(materialize(keep, "kept-rows"), "row_hash", "left_semi")
    # The join has dealt and sorted the rows by this column: no second shuffle.
    return stays.dropDuplicates(["row_hash"]).drop("row_hash")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

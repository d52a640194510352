"""Vectors: cosine distance, exact nearest neighbours, and a hashing embedder."""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexmill.functions.text import words
from lexmill.operators.numbering import numbered, written

HASH_DIM = 128
#: The budget of one embedding batch, batch size x tokens squared.
COST_BUDGET, MAX_BATCH = 16 * 512**2, 256
#: Vectors in a block of rows and in a block of queries.
ROWS_IN_BLOCK, QUERIES_IN_BLOCK = 4096, 512
#: Bytes of vectors: of a slice of rows, of a group of queries, and of what waits for a block to fill.
SLICE_BYTES, GROUP_BYTES, WAITING_BYTES = 16 << 20, 8 << 20, 32 << 20
#: Lists of words that are hashed at a time.
LISTS_AT_ONCE = 2048
#: Vectors that tell blocks apart, and what rounding may add to an angle.
PIVOTS, ANGLE_SLACK = 64, 1e-7
#: Distances of many queries are rounded before they rank, so that ties are ties and the key decides.
DISTANCE_DIGITS = 12
#: What rounding a distance may hide of a likeness.
LIKENESS_SLACK = 1e-11


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """0 for the same direction; null where a vector is all zeros."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector_literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<double>")


def nearest(rows: DataFrame, vector: list[float], k: int, key: str, column: str, where: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows by cosine distance, exactly; ``where`` is applied before."""
    rows = rows if where is None else rows.filter(where)
    ranked = rows.withColumn("distance", cosine_distance(F.col(column), vector_literal(vector)))
    return ranked.filter(F.col("distance").isNotNull()).orderBy("distance", key).limit(k)


def nearest_each(rows: DataFrame, queries: DataFrame, k: int, key: str, column: str, query_key: str, query_column: str) -> DataFrame:
    """(query_key, key, distance, rank): the ``k`` nearest rows of every query, exactly.

    Both sides are packed into blocks of vectors that lie near the same pivot.  A block is a cap on the unit sphere:
    its middle and the largest angle from it.  By the triangle inequality two caps bound the distances between
    their vectors on both sides, so a look at the caps alone says within which distance each block of queries
    has ``k`` rows, and which blocks of rows can hold any of them.  Blocks are dealt to slices of rows and groups of
    queries, each of bounded bytes; a task meets one slice with one group, and hands on ``k`` rows of each query.
    A vector is shuffled once for each group (or slice) of the other side, not once for each pair of blocks.
    Nothing but ``PIVOTS`` vectors goes through the driver."""
    pivots = _pivots(rows, key, column)
    left = written(_packed(rows, key, column, ROWS_IN_BLOCK, pivots))
    asked = queries.select(query_key, query_column)
    per_task = max(1, GROUP_BYTES // (8 * max(1, pivots.shape[-1])))
    asked = asked.repartition(max(1, -(-asked.count() // per_task)))  # many to a task, else they make blocks of a few
    right = written(_packed(asked, query_key, query_column, QUERIES_IN_BLOCK, pivots).withColumnsRenamed({"block": "query_block", "middle": "query_middle", "angle": "query_angle"}))
    held = lambda blocks, most: max(1, -(-(blocks.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0) // most))
    slices, groups = held(left, SLICE_BYTES), held(right, GROUP_BYTES)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = left.select(F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), each(groups).alias("group"), "keys", "vectors", "middle", "angle")
    bounded = right.join(_within(_bounds(left, right), k), "query_block", "left")
    posed = bounded.select(each(slices).alias("slice"), F.pmod(F.xxhash64("query_block"), F.lit(groups)).cast("int").alias("group"), "keys", "vectors", F.col("query_middle").alias("middle"), F.col("query_angle").alias("angle"), "within")
    schema = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, distance double"
    candidates = dealt.groupBy("slice", "group").cogroup(posed.groupBy("slice", "group")).applyInArrow(_slice_candidates(k, key, query_key), schema)
    best = Window.partitionBy(query_key).orderBy("distance", key)
    return candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _bounds(left: DataFrame, right: DataFrame) -> DataFrame:
    """(block, query_block, n, low, high): within which angles the vectors of two blocks lie, by their caps alone."""
    caps = left.select("block", "middle", "angle", "n").crossJoin(right.select("query_block", "query_middle", "query_angle"))
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("middle"), F.col("query_middle")))))
    reach = F.col("angle") + F.col("query_angle") + ANGLE_SLACK
    return caps.select("block", "query_block", "n", F.greatest(between - reach, F.lit(0.0)).alias("low"), F.least(between + reach, F.lit(math.pi)).alias("high"))


def _within(bounds: DataFrame, k: int) -> DataFrame:
    """(query_block, within): the angle within which each of its queries has ``k`` rows; null if there are fewer rows."""
    rising = Window.partitionBy("query_block").orderBy("high", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = bounds.withColumn("held", F.sum("n").over(rising))
    return held.groupBy("query_block").agg(F.min(F.when(F.col("held") >= k, F.col("high"))).alias("within"))


def pairs_of_blocks(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(block, query_block, needed): every block of rows with every block of queries, by their caps alone."""
    bounds = _bounds(left, right)
    return bounds.join(_within(bounds, k), "query_block").select("block", "query_block", (F.col("within").isNull() | (F.col("low") <= F.col("within"))).alias("needed"))


def _pivots(rows: DataFrame, key: str, column: str) -> np.ndarray:
    """At most ``PIVOTS`` directions of rows, chosen by a hash of their keys."""
    found = rows.filter(F.col(column).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(column).cast("array<double>").alias("v")).orderBy("h").limit(PIVOTS).toArrow()
    vectors = [np.array(v, dtype=np.float64) for v in found.column("v").to_pylist()]
    lengths = [float(np.linalg.norm(v)) for v in vectors]
    return np.array([v / n for v, n in zip(vectors, lengths) if n > 0 and np.isfinite(n)])


def _packed(rows: DataFrame, key: str, column: str, size: int, pivots: np.ndarray) -> DataFrame:
    """(block, keys, vectors, middle, angle, n): blocks of rows of the same nearest pivot, their vectors scaled to unit
    length, as rows of one matrix of 64-bit floats; rows without a vector or with one of zeros are left out."""

    def told(keys: pa.Array, matrix: np.ndarray, number: int) -> pa.RecordBatch:
        middle = matrix.sum(axis=0)
        norm = np.linalg.norm(middle)
        middle = middle / norm if norm > 1e-9 else matrix[0]
        angle = float(np.arccos(np.clip((matrix @ middle).min(), -1, 1)))
        own = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), own, pa.array([matrix.tobytes()], pa.binary()), pa.array([middle.tolist()], pa.list_(pa.float64())), pa.array([angle]), pa.array([len(matrix)])],
            names=["block", "keys", "vectors", "middle", "angle", "n"],
        )

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        # What waits for a block of its pivot to fill; over ``WAITING_BYTES`` the fullest goes as it is.
        waiting: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        sizes: dict[int, int] = {}

        def taken(pivot: int) -> tuple[pa.Array, np.ndarray]:
            keys, parts = zip(*waiting.pop(pivot))
            sizes.pop(pivot)
            return pa.concat_arrays(keys), np.concatenate(parts)

        for batch in batches:
            matrix = np.array(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            length = np.linalg.norm(matrix, axis=1)
            kept = length > 0
            keys, matrix = batch.column(0).filter(pa.array(kept)), matrix[kept] / length[kept, None]
            pivot = (matrix @ pivots.T).argmax(axis=1) if len(pivots) and len(matrix) else np.zeros(len(matrix), np.int64)
            order = np.argsort(pivot, kind="stable")
            cuts = np.flatnonzero(np.diff(pivot[order])) + 1
            for same in np.split(order, cuts) if len(order) else []:
                near = int(pivot[same[0]])
                waiting.setdefault(near, []).append((keys.take(pa.array(same)), matrix[same]))
                sizes[near] = sizes.get(near, 0) + len(same)
                if sizes[near] >= size:
                    own, held = taken(near)
                    full = len(held) // size * size
                    for at in range(0, full, size):
                        yield told(own.slice(at, size), held[at : at + size], number)
                        number += 1
                    if full < len(held):
                        waiting[near], sizes[near] = [(own.slice(full), held[full:].copy())], len(held) - full
            while sum(sizes.values()) * 8 * matrix.shape[1] > WAITING_BYTES:
                yield told(*taken(max(sizes, key=sizes.get)), number)
                number += 1
        for near in list(waiting):
            yield told(*taken(near), number)
            number += 1

    return rows.filter(F.col(column).isNotNull()).select(key, column).mapInArrow(run, f"block long, keys array<{rows.schema[key].dataType.simpleString()}>, vectors binary, middle array<double>, angle double, n long")


def _matrices(blocks: pa.Table) -> list[np.ndarray]:
    """The vectors of each block."""
    sizes = pc.list_value_length(blocks.column("keys")).to_pylist()
    return [np.frombuffer(v.as_buffer(), np.float64).reshape(n, -1) for v, n in zip(blocks.column("vectors"), sizes)]


def _slice_candidates(k: int, key: str, query_key: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids = (t.column("keys").combine_chunks().flatten() for t in (left, right))
        asked_blocks, numbers, nears, distances = [], [], [], []
        if len(keys) and len(ids):
            rank_of = np.empty(len(keys), np.int64)
            rank_of[np.array(pc.array_sort_indices(keys))] = np.arange(len(keys))
            own_blocks, asked_blocks = _matrices(left), _matrices(right)
            first = np.cumsum([0, *map(len, own_blocks)])
            middle, query_middle = (np.array(t.column("middle").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (left, right))
            between = np.arccos(np.clip(query_middle @ middle.T, -1, 1))
            low = np.maximum(between - np.array(left.column("angle")) - np.array(right.column("angle"))[:, None] - ANGLE_SLACK, 0)
            within = right.column("within").to_numpy()
            needed = np.isnan(within)[:, None] | (low <= within[:, None])
        at = 0
        for number, asked in enumerate(asked_blocks):
            # The best of each query so far, in order, and the least likeness that may still be among them.
            query, near, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            least = np.full(len(asked), -np.inf)
            for block in np.flatnonzero(needed[number])[np.argsort(low[number][needed[number]], kind="stable")].tolist():
                like = asked @ own_blocks[block].T
                take = min(k, like.shape[1])
                floor = least
                if np.isinf(least).any():
                    floor = np.maximum(least, np.partition(like, -take, axis=1)[:, -take] - LIKENESS_SLACK)
                more, place = np.nonzero(like >= floor[:, None])
                if not len(more):
                    continue
                query, near = np.concatenate([query, more]), np.concatenate([near, first[block] + place])
                distance = np.concatenate([distance, np.round(1 - like[more, place], DISTANCE_DIGITS) + 0.0])
                by = np.lexsort((rank_of[near], distance, query))
                query, near, distance = query[by], near[by], distance[by]
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                kept = rank < k  # ties with the last one came in, too; the key decides
                query, near, distance, last = query[kept], near[kept], distance[kept], rank[kept] == k - 1
                least[query[last]] = 1 - distance[last] - LIKENESS_SLACK
            numbers.append(at + query)
            nears.append(near)
            distances.append(distance)
            at += len(asked)
        query, near, distance = (np.concatenate([np.zeros(0, kind), *own]) for kind, own in ((np.int64, numbers), (np.int64, nears), (np.float64, distances)))
        return pa.table([ids.take(pa.array(query)), keys.take(pa.array(near)), pa.array(distance)], names=[query_key, key, "distance"])

    return run


# ---------------------------------------------------------------- embedding


class Embedder(Protocol):
    """What an embedding model offers; texts in, vectors of ``dim`` floats out, in order."""

    model_id: str
    dim: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashEmbedder:
    """The offline embedder: hashed words, unit length; the same vectors as ``hash_embedding``."""

    model_id = f"hash-{HASH_DIM}"
    dim = HASH_DIM

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        words = [[w.lower() for w in re.findall(r"\w+", text)] for text in texts]
        return hashed_bags(pa.array(words, pa.list_(pa.string())), self.dim).astype(np.float32)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


def room_for(lengths: np.ndarray, max_batch: int = MAX_BATCH) -> np.ndarray:
    """How many texts of a length one batch may hold (cost: the square of half the characters), one at least."""
    half = np.maximum(lengths // 2, 1).astype(np.int64)
    return np.clip(COST_BUDGET // (half * half), 1, max_batch)


def batches_by_cost(lengths: list[int], max_batch: int = MAX_BATCH) -> list[list[int]]:
    """Indices in batches: texts that have the same room, in the order of their length, as many to a batch as it holds
    (the rule of ``batches_of_documents``)."""
    lengths_ = np.asarray(lengths, dtype=np.int64)
    rooms = room_for(lengths_, max_batch)
    order = np.lexsort((np.arange(len(lengths_)), lengths_, -rooms))
    out = []
    for own in np.split(order, np.flatnonzero(np.diff(rooms[order])) + 1) if len(order) else []:
        out += [own[i : i + rooms[own[0]]].tolist() for i in range(0, len(own), int(rooms[own[0]]))]
    return out


def batches_of_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, room, batch): texts numbered into embedding batches over a whole table.

    ``room`` is how many texts of a length one batch may hold; within a room texts stand in the order of
    their length and every ``room`` of them are a batch.  A text's number is its row in its range of
    (room, length, key) and what earlier ranges hold, so no room is counted in one task."""
    n = F.length(F.coalesce(text, F.lit("")))
    half = F.greatest(F.floor(n / 2), F.lit(1))
    room = F.least(F.lit(MAX_BATCH), F.greatest(F.lit(1), F.floor(COST_BUDGET / (half * half)))).cast("long")
    sized = docs.select(key, n.alias("n"), room.alias("room"))
    return numbered(sized, ["room"], ["n", key]).select(key, "room", F.floor((F.col("number") - 1) / F.col("room")).alias("batch"))


def embedding_column(text: Column, embedder: Embedder) -> Column:
    """Vectors of a column of texts, batched by cost inside each Arrow batch."""

    @F.arrow_udf(ArrayType(FloatType()))
    def embed(texts: pa.Array) -> pa.Array:
        values = [t or "" for t in texts.to_pylist()]
        out: list = [None] * len(values)
        for batch in batches_by_cost([len(v) for v in values]):
            for i, vector in zip(batch, embedder.embed_documents([values[i] for i in batch])):
                out[i] = np.asarray(vector, dtype=np.float32)
        return pa.array(out, pa.list_(pa.float32()))

    return embed(text)


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:4])


def hashed_bags(words_of: pa.Array, dim: int) -> np.ndarray:
    """Counts of hashed words, a row of unit length for each list; zeros where a list is empty."""
    return np.concatenate([_few_bags(words_of.slice(at, LISTS_AT_ONCE), dim) for at in range(0, max(1, len(words_of)), LISTS_AT_ONCE)])


def _few_bags(words_of: pa.Array, dim: int) -> np.ndarray:
    counts = pc.fill_null(pc.list_value_length(words_of), 0).to_numpy(zero_copy_only=False)
    encoded = words_of.flatten().dictionary_encode()
    told = [_hash(w) % dim for w in encoded.dictionary.to_pylist()]
    bucket = np.array(told, dtype=np.int64)[encoded.indices.to_numpy(zero_copy_only=False)] if told else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    out = np.bincount(row * dim + bucket, minlength=len(counts) * dim).astype(np.float64).reshape(len(counts), dim)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def hash_embedding(docs: DataFrame, key: str, dim: int = HASH_DIM) -> DataFrame:
    """(key, vector): counts of hashed terms, of unit length; all zeros for a text without terms.  A map: each distinct
    word of an Arrow batch is hashed once."""

    @F.arrow_udf("array<double>")
    def embed(lists: pa.Array) -> pa.Array:
        vectors = hashed_bags(lists, dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * dim), pa.array(vectors.ravel()))

    return docs.select(key, embed(words(F.coalesce("text", F.lit("")))).alias("vector"))

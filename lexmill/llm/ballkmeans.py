"""Ball k-means: clusters as balls, so that most vectors meet few centroids.

A vector ``x`` of the cluster ``j`` can only move to a centroid ``i`` with ``|c_i - c_j| <= 2 |x - c_j|``
(triangle inequality).  So a centroid is a neighbour of ``j`` if it lies within twice the radius
of ``j``'s ball, and the neighbours in order of their distance cut the ball into annuli: the core
inside half the way to the nearest neighbour is stable, and a member of the n-th annulus is
compared with the n nearest neighbours, exactly.  The radius of a ball whose centroid moved is
bounded by the old radius and the way it moved, so no pass over the members is needed for it.

Components are integers, ``floor(scale * x)``, and so are centroids and squared distances: all
comparisons, ties and sums are exact, and the result does not depend on the partitioning.  An
equal distance counts as near enough to compare, and the smaller number wins.

Each round writes the vectors with their cluster and distance to the shared folder, and drops the
table before it.  Sums are added within tasks, then by Spark for each (cluster, component).  Only
the centroids, ``k`` rows, and their sums are ever on the driver: ``k`` is a parameter, at most
``MAX_K``.  Equal vectors, however many, meet in no task.

Defined cases: vectors that are null, of another length, or with null, NaN or infinite components
are left out; a null id is hashed as ``2:`` and keeps its row; repeated rows stay rows of their own,
and take one centroid each at the start; of equal hashes the smaller vector comes first; with fewer
than ``k`` vectors there are as many clusters as vectors; an empty table gives no rows; a component
beyond ``LARGEST`` after scaling raises ValueError, as its distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import drop_table, materialize, table

K, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
MAX_K = 4096
LARGEST = 1 << 26
STATE = "vec_id long, vector binary, cluster int, distance long, compared int"
#: Places of a cluster's statistics beside the sums of its components.
COUNT, INERTIA = -1, -2


@dataclass
class Clusters:
    """``assigned``: vec_id, vector (32-bit integers), cluster, distance (squared), compared (centroids that the
    vector met in the last assignment); ``centroids``; ``inertia`` of each cluster."""

    assigned: DataFrame
    centroids: np.ndarray
    inertia: np.ndarray


def squared_distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", apart, apart)


def neighbours(centroids: np.ndarray, radii: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball: (its neighbour centroids, their squared distances), the nearest first."""
    out = []
    for j, radius in enumerate(radii):
        far = squared_distances(centroids, centroids[j])
        near = np.flatnonzero(far <= min(4 * radius * radius, (1 << 63) - 1))
        near = near[near != j]
        near = near[np.argsort(far[near], kind="stable")]
        out.append((near, far[near]))
    return out


def assign(vectors: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, around: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, centroids met) of vectors whose clusters were ``cluster`` before."""
    new, distance, met = cluster.copy(), np.zeros(len(vectors), np.int64), np.ones(len(vectors), np.int32)
    by_cluster = np.argsort(cluster, kind="stable")
    firsts = np.flatnonzero(np.diff(cluster[by_cluster], prepend=-1))
    for members in np.split(by_cluster, firsts[1:]) if len(firsts) else []:
        j = int(cluster[members[0]])
        own = squared_distances(vectors[members], centroids[j])
        outward = np.argsort(-own, kind="stable")
        members, own = members[outward], own[outward]
        best, number = own.copy(), np.full(len(members), j, np.int32)
        near, far = around[j]
        # Members are sorted from the rim inwards: those that reach a neighbour's annulus are the first ones.
        reach = np.searchsorted(-4 * own, -far, side="right")
        for i, n in zip(near.tolist(), reach.tolist()):
            if not n:
                break
            to_it = squared_distances(vectors[members[:n]], centroids[i])
            closer = (to_it < best[:n]) | ((to_it == best[:n]) & (i < number[:n]))
            best[:n][closer], number[:n][closer] = to_it[closer], i
            met[members[:n]] += 1
        new[members], distance[members] = number, best
    return new, distance, met


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    return np.frombuffer(column.buffers()[2] or b"", "<i4", len(column) * dimensions).reshape(-1, dimensions)


def _binaries(vectors: np.ndarray) -> pa.Array:
    n, width = vectors.shape[0], 4 * vectors.shape[1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int64) * width), pa.py_buffer(np.ascontiguousarray(vectors, "<i4"))]).cast(pa.binary())


def scaled(lists: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    """Lists of ``dimensions`` finite numbers as integers ``floor(scale * x)``."""
    values = np.floor(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale}: distances would not fit 64 bits")
    return values.astype(np.int32).reshape(-1, dimensions)


def _first_state(dimensions: int, scale: int):
    def run(batches):
        for batch in batches:
            vectors = scaled(batch.column("vector"), dimensions, scale)
            zeros = np.zeros(len(vectors), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _binaries(vectors), pa.array(zeros.astype(np.int32)), pa.array(zeros), pa.array(zeros.astype(np.int32))], names=["vec_id", "vector", "cluster", "distance", "compared"])

    return run


def _assign_batches(centroids: np.ndarray, around: list[tuple[np.ndarray, np.ndarray]]):
    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column("vector"), centroids.shape[1])
            cluster, distance, met = assign(vectors, batch.column("cluster").to_numpy(), centroids, around)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cluster), pa.array(distance), pa.array(met)], names=["vec_id", "vector", "cluster", "distance", "compared"])

    return run


def _add_up(k: int, dimensions: int):
    """Sums of a task by cluster: components, count, inertia, and the largest distance."""

    def run(batches):
        sums, count, inertia, most = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster, distance = batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
            order = np.argsort(cluster, kind="stable")
            firsts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            if not len(firsts):
                continue
            own = cluster[order][firsts]
            sums[own] += np.add.reduceat(_matrix(batch.column("vector"), dimensions)[order], firsts, axis=0, dtype=np.int64)
            count[own] += np.diff(firsts, append=len(order))
            inertia[own] += np.add.reduceat(distance[order], firsts)
            most[own] = np.maximum(most[own], np.maximum.reduceat(distance[order], firsts))
        used = np.flatnonzero(count)
        places = np.concatenate([np.arange(dimensions), [COUNT, INERTIA]])
        totals = np.concatenate([sums, count[:, None], inertia[:, None]], axis=1)[used]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, len(places)).astype(np.int32)), pa.array(np.tile(places, len(used)).astype(np.int32)), pa.array(totals.ravel()), pa.array(np.repeat(most[used], len(places)))], names=["cluster", "place", "total", "most"])

    return run


def _statistics(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, inertia, largest squared distance) by cluster; k * (dimensions + 2) rows reach the driver."""
    parts = state.select("vector", "cluster", "distance").mapInArrow(_add_up(k, dimensions), "cluster int, place int, total long, most long")
    rows = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.max("most").alias("most")).toArrow()
    cluster, place, total = (rows.column(c).to_numpy() for c in ("cluster", "place", "total"))
    table_of, most = np.zeros((k, dimensions + 2), np.int64), np.zeros(k, np.int64)
    table_of[cluster, place] = total  # the negative places are the last columns
    most[cluster] = rows.column("most").to_numpy()
    return table_of[:, :dimensions], table_of[:, COUNT], table_of[:, INERTIA], most


def _kept(vector: Column, dimensions: int) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, finite), F.lit(False))


def ball_kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = "2:") -> Clusters:
    """Cluster ``vectors`` (vec_id, embedding): ``rounds`` of assigning and averaging, and a last assignment."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter(_kept(F.col("vector"), dimensions))
    chosen = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = source.select(chosen.alias("chosen"), "vector").orderBy("chosen", "vector").limit(k).toArrow()
    state = materialize(source.mapInArrow(_first_state(dimensions, scale), STATE), "balls")
    centroids = scaled(pc.take(start.column("vector"), np.argsort(start.column("chosen").to_numpy(), kind="stable")).combine_chunks(), dimensions, scale).astype(np.int64)
    n = len(centroids)
    if not n:
        return Clusters(state, centroids, np.zeros(0, np.int64))
    # Before the first assignment all vectors are in the ball of centroid 0, which reaches everywhere.
    radii = [1 << 31] + [0] * (n - 1)
    for left in reversed(range(rounds + 1)):
        before, state = state, materialize(state.mapInArrow(_assign_batches(centroids, neighbours(centroids, radii)), STATE), "balls")
        drop_table(before)
        sums, counts, inertia, most = _statistics(state, n, dimensions)
        if not left:
            return Clusters(state, centroids, inertia)
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        ways = [int(w) for w in np.einsum("ij,ij->i", moved - centroids, moved - centroids)]
        radii = [math.isqrt(int(m)) + math.isqrt(w) + 2 if c else 0 for m, w, c in zip(most, ways, counts)]
        centroids = moved
    raise ValueError("rounds must not be negative")


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = ball_kmeans(vectors, k, rounds, dimensions, scale)
    total = int(found.inertia.sum())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    rows = [(j, int(own), total, digest[j]) for j, own in enumerate(found.inertia)]
    told = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds one after another, every vector against every centroid."""
    nearest = lambda c: f"""
        SELECT vec_id, v, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
          SELECT k.n, k.vec_id, k.v, c.cluster, list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
          FROM kept k CROSS JOIN {c} c) GROUP BY n, vec_id, v"""  # noqa: E731
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        steps.append(f"""s{r} AS (SELECT cluster, place, floor(sum(x) / count(*))::BIGINT AS x FROM (
          SELECT cluster, unnest(v) AS x, unnest(range({DIMENSIONS})) AS place FROM a{r}) GROUP BY cluster, place)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (
          SELECT cluster, list(x ORDER BY place) AS c FROM s{r} GROUP BY cluster) n USING (cluster))""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {DIMENSIONS} AND list_sum(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END)) = 0 AND list_count(embedding) = {DIMENSIONS}),
      c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, v AS c FROM (
        SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h LIMIT {K})),
      {", ".join(steps)},
      last AS MATERIALIZED ({nearest(f"c{ROUNDS}")})
      SELECT l.vec_id, l.cluster, l.distance, (sum(l.distance) OVER (PARTITION BY l.cluster))::BIGINT AS cluster_inertia, (sum(l.distance) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(c.c, ',')) AS centroid_sha256
      FROM last l JOIN c{ROUNDS} c USING (cluster)"""


OP13_SQL = _sql()

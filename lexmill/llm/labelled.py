"""Bounded samples of labelled documents to fit a classifier on.

Only rows whose crc32(doc_id as text) modulo ``FOLDS`` is not 0 are ever learned from.  The
sample is, for each class, the ``per_class[class]`` rows whose hashed ids come first: the bound does
not depend on the size of the tables, and the same rows are drawn on every run.  A doc_id that
is labelled more than once has the highest of its labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import crc_bucket, materialize

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return crc_bucket(doc_id, FOLDS) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], max_chars: int) -> tuple[DataFrame, float]:
    """(doc_id, text, y: int) of the sampled documents in the order of their hashed ids, and the share
    of class 1 among all rows that may be learned from.

    Each class takes rows until it holds half of ``max_chars``, so no number of very long texts is
    too much; of rows that share an id, that whose text has the smallest hash."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    usable = materialize(usable.join(docs.select("doc_id"), "doc_id", "left_semi"), "usable-labels")
    share = usable.agg(F.avg("y")).first()[0]
    order = F.xxhash64("doc_id")
    picked = [usable.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class[y]).select("doc_id", "y") for y in (0, 1)]
    ids = picked[0].union(picked[1])
    one = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    held = materialize(one.withColumn("hashed", order), "labelled-sample")
    # Windows over the picked rows only: at most ``per_class``.
    before = Window.partitionBy("y").orderBy("hashed", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = held.select("doc_id", "y", "hashed", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("chars_before"))
    taken = taken.filter(F.col("chars_before") < max_chars // 2).select("doc_id")
    sample = held.join(F.broadcast(taken), "doc_id").orderBy("hashed", "doc_id").select("doc_id", "text", "y")
    return sample, 0.5 if share is None else float(share)

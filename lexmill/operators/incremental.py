"""Keeping an index up to date: differences, upserts and deletions as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_KEY = ["root_id", "rel_path"]


def classify(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each listed or recorded file with a ``status``: new, unchanged, candidate (its size or
    time changed, so its content must be hashed) or removed."""
    old = manifest.select(*FILE_KEY, F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime_ns"), F.col("content_hash").alias("old_hash"), F.col("chunk_count").alias("old_chunk_count"), F.col("status").alias("old_status"), F.lit(True).alias("is_old"))
    new = listing.select(*FILE_KEY, "size", "mtime_ns", F.lit(True).alias("is_new"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime_ns"))
    status = F.when(F.col("is_new").isNull(), "removed").when(F.col("is_old").isNull(), "new").when(same, "unchanged").otherwise("candidate")
    return new.join(old, FILE_KEY, "full").withColumn("status", status).drop("is_new", "is_old")


def settle(read: DataFrame) -> DataFrame:
    """Files that were read, by their content: touched (same hash; the record keeps its chunks and
    status), unreadable, or indexed."""
    same = F.col("old_hash").isNotNull() & (F.col("content_hash") == F.col("old_hash"))
    outcome = F.when(F.col("error").isNotNull(), "error").when(same, "touched").when(F.col("text").isNull(), "unreadable").otherwise("indexed")
    return read.withColumn("outcome", outcome)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` in place of rows of the same key; of equal keys in ``new`` one row stays."""
    new = new.dropDuplicates(key)
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(keys.select(*key).distinct(), key, "left_anti")


def stale_roots(manifest: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots that are recorded but no longer configured."""
    return manifest.select("root_id").distinct().join(roots.select("root_id"), "root_id", "left_anti")


def replace_chunks(chunks: DataFrame, new_chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the chunks of files that were replaced or are gone, with the new ones."""
    touched = new_chunks.select("file_id").union(gone.select("file_id"))
    return delete(chunks, touched, ["file_id"]).unionByName(new_chunks)


def report(outcomes: DataFrame) -> DataFrame:
    """One row of counters over the outcomes of a run."""
    count = lambda *which: F.count_if(F.col("status").isin(*which))
    return outcomes.agg(
        count("indexed", "new", "changed").alias("indexed"), count("unchanged", "touched").alias("unchanged"), count("removed").alias("removed"),
        count("unreadable").alias("unreadable"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"),
    )


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("status") == "indexed").agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))

"""Schemas of the index's tables and of search results."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

SCHEMA_VERSION, CHUNKER_VERSION = 3, 2


def _struct(strings: str = "", **other) -> StructType:
    return StructType([*(StructField(n, StringType()) for n in strings.split()), *(StructField(n, t) for n, t in other.items())])


CHUNKS = _struct("id file_id root_id origin rel_path language symbol text search_text", start_line=IntegerType(), end_line=IntegerType(), vector=ArrayType(FloatType()))
MANIFEST = _struct("root_id rel_path file_id content_hash language status indexed_at", size=LongType(), mtime_ns=LongType(), chunk_count=LongType())
#: Postings carry what searches are narrowed by.
POSTINGS = _struct("term id file_id root_id origin", tf=LongType(), dl=LongType())
SIZES = _struct("file_id", n=LongType(), terms=LongType())
#: ``what`` ends: the record of a file, or its content (chunks, postings and sizes).
TOMBSTONES = _struct("file_id what")
META = _struct("key value")
TABLES = {"chunks": CHUNKS, "manifest": MANIFEST, "postings": POSTINGS, "sizes": SIZES, "tombstones": TOMBSTONES, "meta": META}
SEARCH_HIT = _struct("id root_id rel_path language symbol origin text", start_line=IntegerType(), end_line=IntegerType(), score=DoubleType(), vector_rank=IntegerType(), text_rank=IntegerType(), vector_distance=DoubleType(), text_score=DoubleType())

"""Shared helpers: working tables, checked broadcasts, and text columns."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    On one machine the warehouse will do where the session names none; on a cluster that is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/lexmill/{spark.sparkContext.applicationId}"


def clear_working_tables(spark: SparkSession) -> None:
    """Remove all tables and files that this application's operators wrote on their way; call it once
    their results are written elsewhere."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def with_scheme(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as pyarrow's file systems want it."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the actions inside go as soon as their action ends."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts the lineage, and a
    lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffle_cleanup(spark):
        df.write.partitionBy(*(partition_by or [])).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_lexmill_path", None)
    if path:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(conf).delete(hadoop_path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Hint a broadcast only after counting rows against a bound; beyond it Spark joins by
    shuffling."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


HOT_ROWS, HOT_SHARE, SALTS = 10_000, 1000, 64


def hot_keys(counted: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """The keys of ``counted`` that hold over ``HOT_ROWS`` rows and over one in ``HOT_SHARE`` of all ``total``
    rows: so at most ``HOT_SHARE`` keys."""
    return counted.filter(F.col(n) > max(HOT_ROWS, total // HOT_SHARE)).select(*keys)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: Column, how: str = "inner", apart: Column | None = None) -> DataFrame:
    """Join with ``right``, which has one row for each key; no key is null.

    Rows of ``left`` with a key in ``hot`` (see ``hot_keys``: few, so it is broadcast) are dealt over ``SALTS``
    salts by ``spread``, and rows of ``right`` with such a key are copied for each salt.  Rows where
    ``apart`` holds have no partner in ``right`` and are dealt freely."""
    marked = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    salt = F.when(F.col("is_hot"), F.pmod(spread, F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    if apart is not None:
        salt = F.when(apart, -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))).otherwise(salt)
    salted = left.join(marked, keys, "left").withColumn("salt", salt).drop("is_hot")
    copied = right.join(marked, keys, "left").withColumn("salt", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("is_hot")
    return salted.join(copied, [*keys, "salt"], how).drop("salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def chunks_by_total(n_units: int, per_chunk: int) -> int:
    return max(1, -(-n_units // per_chunk))


def tasks_for(total_bytes: int, small: int = 16_000_000, many: int = 4096, large: int = 1_000_000_000) -> int:
    """Partitions for so many bytes: some ``small`` bytes each until there are ``many`` of them, at
    most ``large`` bytes each beyond that."""
    return max(1, min(-(-total_bytes // small), many), -(-total_bytes // large))

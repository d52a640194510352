"""Row numbers over groups of any size, and tables that are written once and read again."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def working_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the checkpoint folder.  On one machine the warehouse
    will do where none is named; on a cluster that may be a folder of one machine, so it is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/lexmill-work/{spark.sparkContext.applicationId}"


def clear_working_tables(spark: SparkSession) -> None:
    """Remove what this application's ``written`` tables left; call it once their results are written elsewhere."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(working_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, folder: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """The same rows from Parquet files: later steps read them, whatever becomes of the executors.  Rows are read thousands
    at a time, but of one row group only: where rows are long, ``group_bytes`` bounds what a task holds of them."""
    spark = df.sparkSession
    path = f"{folder or working_folder(spark)}/{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``number``: the row number within its group (from 1) by ``order``, which must tell
    rows apart.  Rows are dealt by ranges and written, so that each row's range stays what it was; a
    group may lie over any number of ranges."""
    ranged = written(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    return ranged.withColumn("_within", within).join(offsets, [*group, "_part"]).withColumn("number", F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")

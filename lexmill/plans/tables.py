"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, values: list[str], columns: str) -> DataFrame:
    """A small table of literals, in SQL."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS t({columns})")

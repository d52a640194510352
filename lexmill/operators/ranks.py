"""Exact order statistics of groups of any size, without a task that holds a group.

Each wanted rank is known to lie in a range of values.  A pass counts the range in ``BUCKETS`` parts (added within
tasks, then by Spark), and the part that holds the rank becomes the range, from its least value to its
largest.  Once a range holds at most ``FEW`` rows, or one value, the rank is read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.numbering import written

BUCKETS, FEW = 1024, 10_000
#: Wanted ranks up to this number are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000


def _joined(rows: DataFrame, wanted: DataFrame, by: list[str], n: int) -> DataFrame:
    """Rows with the wanted ranks of their group; null groups are groups, too."""
    own = wanted.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in wanted.columns if c not in by))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(F.broadcast(own) if n <= MAX_BROADCAST else own, same).drop(*(f"_{c}" for c in by))


def values_at(rows: DataFrame, by: list[str], value: str, ranks: Column, few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(by, rank, value): the values at ``ranks`` (an array of 0-based ranks, made of the column ``n``, the group's number
    of values) of each group in rising order.  Null values don't count, NaN is larger than any number."""
    base = rows.select(*by, F.col(value).cast("double").alias("v")).filter("v is not null")
    open_ = base.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    open_ = open_.select(*by, F.explode(F.array_distinct(ranks.cast("array<bigint>"))).alias("rank"), "lo", "hi", "n").withColumn("before", F.lit(0).cast("long"))
    open_, done = written(open_), []
    while True:
        settled = (F.col("lo") == F.col("hi")) | (F.col("n") <= few)
        done.append(open_.filter(settled))
        open_ = open_.filter(~settled)
        n = open_.count()
        if not n:
            break
        within = _joined(base, open_.select(*by, "rank", "lo", "hi"), by, n).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        # Parts of equal width between the finite ends; what isn't finite is the last part's.
        width = F.nullif(F.col("hi") / buckets - F.col("lo") / buckets, F.lit(0.0))
        part = F.when((F.col("v") - F.col("lo")) / width < buckets - 1, F.floor((F.col("v") - F.col("lo")) / width)).otherwise(F.lit(buckets - 1))
        part = F.when(F.col("v") == F.col("lo"), F.lit(-1)).when(F.col("v") == F.col("hi"), F.lit(buckets)).otherwise(F.greatest(part, F.lit(0)))
        counts = within.groupBy(*by, "rank", part.cast("int").alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("part"))  # at most ``BUCKETS`` + 2 rows
        placed = _joined(counts.withColumn("upto", upto), open_.select(*by, F.col("rank").alias("_rank"), "before"), by, n).filter(F.col("rank") == F.col("_rank")).drop("_rank")
        held = (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n")) & (F.col("rank") < F.col("before") + F.col("upto"))
        open_ = written(placed.filter(held).select(*by, "rank", "lo", "hi", "n", (F.col("before") + F.col("upto") - F.col("n")).alias("before")))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    one = found.filter(F.col("lo") == F.col("hi")).select(*by, "rank", F.col("lo").alias("value"))
    several = found.filter(F.col("lo") != F.col("hi"))
    near = _joined(base, several, by, several.count()).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    read = near.groupBy(*by, "rank", "before").agg(F.array_sort(F.collect_list("v")).alias("values"))  # at most ``FEW`` values
    return one.unionByName(read.select(*by, "rank", F.get("values", (F.col("rank") - F.col("before")).cast("int")).alias("value")))


def median(rows: DataFrame, by: list[str], value: str, few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(by, median, n): of an even number of values the mean of the two in the middle; null for a group without any."""
    n = F.col("n")
    middle = F.array(F.floor((n - 1) / 2), F.floor(n / 2))
    values = values_at(rows, by, value, middle, few, buckets).groupBy(*by).agg(((F.min("value") + F.max("value")) / 2).alias("median"))
    counted = rows.groupBy(*by).agg(F.count(value).alias("n"))
    own = values.select(*(F.col(c).alias(f"_{c}") for c in by), "median")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return counted.join(own, same, "left").select(*by, "median", "n")

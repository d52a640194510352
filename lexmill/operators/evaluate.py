"""Retrieval quality: distinct files, ranks of expected files, hit@k, MRR, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def distinct_files(ranked: DataFrame, query: list[str], file: list[str], depth: int = 10) -> DataFrame:
    """Ranked rows (``rank``) to ranked files: each file where it first comes, ranked anew."""
    first = ranked.groupBy(*query, *file).agg(F.min("rank").alias("position"))
    order = Window.partitionBy(*query).orderBy("position", *file)
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def first_gold_rank(files: DataFrame, gold: DataFrame, query: list[str], file: list[str]) -> DataFrame:
    """The rank of the first expected file of every query; null where none was found."""
    found = files.join(gold, [*query, *file], "left_semi").groupBy(*query).agg(F.min("rank").alias("gold_rank"))
    return gold.select(*query).distinct().join(found, query, "left")


def hit_rates(results: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """hit@k, MRR and counts of (mode, lang, gold_rank) by mode and language, and over all languages, in one pass."""
    hit = {k: F.avg(F.when(F.col("gold_rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks}
    mrr = (F.sum(F.coalesce(F.when(F.col("gold_rank") <= 10, 1.0 / F.col("gold_rank")), F.lit(0.0))) / F.count("*")).alias("mrr_10")
    sets = results.groupingSets([["mode", "lang"], ["mode"]], "mode", "lang")
    out = sets.agg(F.grouping("lang").alias("whole"), F.count("*").alias("n"), *hit.values(), mrr)
    return out.select("mode", F.when(F.col("whole") == 1, "all").otherwise(F.col("lang")).alias("lang"), "n", *(f"hit_{k}" for k in ks), "mrr_10")


def pivoted(rates: DataFrame, value: str, langs: list[str]) -> DataFrame:
    """One row for each mode, one column for each language."""
    return rates.groupBy("mode").pivot("lang", langs).agg(F.first(value))


def not_measured(models: DataFrame, measured: DataFrame) -> DataFrame:
    """What a resumed evaluation still has to do."""
    return models.join(measured.select("model").distinct(), "model", "left_anti")


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, lang, question, files): one row for each question and language of a benchmark's JSON file,
    an array of {"id", "questions": {lang: text}, "expected": [file, ...]}."""
    shape = "id string, questions map<string, string>, expected array<string>"
    return exploded_questions(spark.read.schema(shape).json(path, multiLine=True))


def exploded_questions(nested: DataFrame) -> DataFrame:
    return nested.select(F.col("id").alias("query_id"), F.explode("questions").alias("lang", "question"), F.col("expected").alias("files"))


def append_report(results: DataFrame, path: str) -> int:
    """Add results (with ``model``) to a stored report; models it has already are left out.  Returns how
    many rows were added, so an evaluation that was interrupted goes on where it stopped."""
    spark = results.sparkSession
    try:
        measured = spark.read.parquet(path).select("model")
    except AnalysisException:
        measured = results.select("model").limit(0)
    fresh = not_measured(results, measured)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def throughput(runs: DataFrame, by: list[str], items: str, seconds: str) -> DataFrame:
    """Items a second over all runs of a group; null where no time passed."""
    total = F.sum(seconds)
    return runs.groupBy(*by).agg(F.sum(items).alias("items"), (F.sum(items) / F.when(total > 0, total)).alias("per_second"))


def installed(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """(model, total_size, n_missing, is_installed) of models whose files (name, size) are pinned: a file
    counts if the listing has it with just that size."""
    files = registry.select("model", F.explode("files").alias("file")).select("model", F.col("file.name").alias("name"), F.col("file.size").alias("pinned"))
    found = files.join(listing.select("model", "name", "size").distinct(), ["model", "name"], "left")
    there = F.coalesce(F.col("size") == F.col("pinned"), F.lit(False))
    by_file = found.groupBy("model", "name", "pinned").agg(F.bool_or(there).alias("there"))
    return by_file.groupBy("model").agg(F.sum("pinned").alias("total_size"), F.count_if(~F.col("there")).alias("n_missing"), F.bool_and("there").alias("is_installed"))

"""What Python holds of large Arrow batches, and the queries over order books that were bound by it."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunking as ch
from lexmill.operators import vectors
from lexmill.operators.outline import outline
from lexmill.operators.slices import sliced
from lexmill.plans import code_queries
from lexmill.sources import folder

TEXTS = ["class A:\n    def f(self):\n        return 1\n\n    x = 1\n", None, "", "def g():\n    pass\ndef g():\n    pass\n", "plain"] * 3


@pytest.mark.parametrize("kind", [pa.string(), pa.binary()])
def test_a_batch_is_cut_by_its_bytes(kind):
    texts = ["a" * 30, None, "é" * 40, "", "b" * 5, "c" * 400, "d", "e" * 99]
    batch = pa.RecordBatch.from_arrays([pa.array(texts).cast(kind), pa.array(range(8))], names=["t", "n"])
    parts = [part.column("t").to_pylist() for part in sliced(batch, "t", 100)]
    assert [t for part in parts for t in part] == batch.column("t").to_pylist()
    held = [[len(t.encode() if isinstance(t, str) else t or b"") for t in part] for part in ([t or "" for t in part] for part in parts)]
    assert all(sum(own) - max(own) < 100 for own in held) and len(parts) == 5
    assert [part.num_rows for part in sliced(batch.slice(0, 0), "t", 100)] == [0]


def _documents(spark):
    return spark.createDataFrame([(i, t, "python" if i % 5 < 4 else "text") for i, t in enumerate(TEXTS)], "k long, text string, language string").coalesce(1)


def test_first_and_last_lines_are_those_of_the_lines(spark):
    docs = _documents(spark)
    lines = ch.line_symbols(docs, "k").filter("symbol <> ''")
    plain = lines.groupBy("k", "symbol").agg(F.min("i").alias("first_row"), F.max("i").alias("end_row"))
    units = ch.unit_rows(docs, "k")
    assert units.schema == ch.line_symbols(docs, "k").selectExpr("k", "symbol", "i AS first_row", "i AS end_row").schema
    assert sorted(map(tuple, units.collect())) == sorted(map(tuple, plain.collect()))
    assert (3, "g", 0, 3) in set(map(tuple, units.collect()))


def test_units_are_told_without_a_shuffle_of_lines(spark, tmp_path):
    spark.range(3000).selectExpr("id AS o_orderkey", "id % 500 AS o_custkey", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    plan = code_queries.unit_end_rows(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_partitions_of_books_are_counted_by_their_bytes(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("id AS o_orderkey", "id % 500 AS o_custkey", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(code_queries, "PARTITION_BYTES", 100_000)
    books = code_queries._books(spark, str(tmp_path), list(code_queries.SOURCES))
    held = books.groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("n")).collect()
    assert books.count() == 20 * len(code_queries.SOURCES)
    assert len(held) > 5 and max(r.n for r in held) < 600_000


@pytest.mark.parametrize("language", ["python", "javascript", "lua", "json"])
def test_a_long_source_takes_a_few_times_its_size(language):
    head, part, foot = ("\n".join(line for line, _ in own) for own in code_queries.SOURCES[language])
    text = "\n".join([head, *(part.replace("{k}", str(k)) for k in range(20_000)), foot])
    lines = ch.lines_of(text)
    tracemalloc.start()
    held = len(outline(lines, language).inner)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held and peak < 14 * len(text)


def test_a_row_of_books_is_built_for_one_language(spark, tmp_path):
    spark.range(3000).selectExpr("id AS o_orderkey", "id % 500 AS o_custkey", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    plan = code_queries._books(spark, str(tmp_path), list(code_queries.SOURCES))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in next(line for line in plan.splitlines() if "Generate" in line)
    assert all("transform(" not in line for line in plan[plan.index("Generate") :].splitlines())


def test_files_are_decoded_and_words_hashed_a_few_at_a_time():
    data = [b"\xef\xbb\xbfa", b"\0b", None, b"caf\xe9", "é".encode()] + [b"x" * 4000] * 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(data), pa.array(range(len(data)))], names=["data", "k"])
    runs = []
    files = SimpleNamespace(columns=["data", "k"], schema=[], select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: runs.append(run)))
    folder.decoded(files, "data")
    told = list(runs[0]([batch]))
    assert max(part.num_rows for part in told) < 2000
    assert [t for part in told for t in part.column("text").to_pylist()] == ["a", None, None, "café", "é"] + ["x" * 4000] * 10_000

    lists = pa.array([["a", "b", "a"], [], None, ["b"]] + [[f"w{i % 997}" for i in range(n, n + 300)] for n in range(4000)])
    tracemalloc.start()
    bags = vectors.hashed_bags(lists, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(bags, np.concatenate([vectors.hashed_bags(lists.slice(i, 1), 16) for i in range(len(lists))]))
    assert vectors.hashed_bags(lists.slice(0, 0), 16).shape == (0, 16) and peak < 20_000_000


def _long_source(language: str, orders: int) -> str:
    head, part, foot = ("\n".join(line for line, _ in own) for own in code_queries.SOURCES[language])
    return "\n".join([head, *(part.replace("{k}", str(k)) for k in range(orders)), foot])


def test_documents_are_cut_once_and_a_long_one_takes_a_few_times_its_size(spark, tmp_path):
    spark.range(3000).selectExpr("id AS o_orderkey", "id % 500 AS o_custkey", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    plan = code_queries.code_chunks(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("ArrowEvalPython") == 1
    empty = spark.createDataFrame([(1, "", "python"), (2, None, "text"), (3, "a", "text")], "k long, text string, language string")
    assert [tuple(r)[:4] for r in ch.chunk_documents(empty, "k").collect()] == [(3, 0, 1, 1)]
    text = _long_source("python", 20_000)
    tracemalloc.start()
    cut = ch.pieces_of(text, "python", code_queries.CONFIG)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cut[-1]["last"] == text.count("\n") and peak < 9 * len(text)


@pytest.mark.parametrize("language", ["python", "javascript", "dart", "lua", "yaml", "json"])
def test_lines_of_one_form_are_looked_at_once(language, monkeypatch):
    from lexmill.operators import outline as ol

    looked, look = [], ol._line
    monkeypatch.setattr(ol, "_line", lambda *own: looked.append(own) or look(*own))
    text = _long_source(language, 2000)
    which, names = ol.innermost(text, language)
    assert len(which) == text.count("\n") + 1 and len(names) > 2000 and len(looked) < 100
    assert sum("1987" in name[-1] for name in names if name) >= 1

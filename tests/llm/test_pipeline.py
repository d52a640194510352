from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from test_decontaminate import brute
from test_simhash_components import fingerprint, linked_groups
from test_tokens_repair_packing import _ids

import corpus_pipeline
from lexmill.llm import packing, quality, toxicity

SF = "/root/testdata/sf0.001"


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_every_stage_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = _rows(docs)
    text = docs.columns.index("text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == docs.columns
        rows = _rows(after)
        texts = [r[text] for r in before]
        if name in ("quality", "toxicity"):
            module, bound = (quality, quality.THRESHOLD) if name == "quality" else (toxicity, toxicity.THRESHOLD)
            score = module.Scorer(module.fit(docs, labels))
            scores = np.concatenate([score(pa.array([t], pa.string())) for t in texts])
            stays = scores >= bound if name == "quality" else scores < bound
            assert rows == [r for r, s in zip(before, stays.tolist()) if s]
        elif name == "near_duplicates":
            groups = linked_groups([fingerprint(t) for t in texts], list(range(len(texts))), 2)
            first = {}
            for row, group in sorted(zip(before, groups), key=lambda x: x[0][0]):
                first.setdefault(group, row)
            assert rows == sorted(first.values(), key=str)
        else:
            dirty = {r[0] for r in brute([(r[0], r[text]) for r in before], benchmark) if r[-1]}
            assert dirty and rows == [r for r in before if r[0] not in dirty]
        docs, before = after, rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ids = {r[0]: _ids(packing.TOKENIZER, r[text], packing.END_ID) for r in before}
    assert sum(r.length for r in packed) == sum(map(len, ids.values())) and {r.doc_id for r in packed} == set(ids)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).first()[0] == sum(r.length for r in packed)


def test_odd_tables(spark, documents, empty, tmp_path):
    """Nulls, repeated rows, clashing columns, and no rows at all."""
    for n, docs in enumerate((documents, empty)):
        folder = str(tmp_path / str(n))
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "lazy dog near the old river bank TODAY")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == documents.columns, name
            docs = corpus_pipeline.materialize(docs, name)
        assert corpus_pipeline.run(spark, folder).count() >= docs.count()

"""The pipeline's stages against what plain versions of their decisions keep."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontam, mixing, neardup, quality
from tests.llm.test_neardup import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        got = f(spark, docs, SF)
        rows = got.collect()
        out.append((docs, got, rows))
        docs = spark.createDataFrame(rows, got.schema)
    return out


def test_columns_and_order(stages, spark):
    kinds = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert len(corpus_pipeline.STAGES) == 5
    assert all(got.dtypes == kinds for _, got, _ in stages[:-1])


def test_decisions_take_effect(stages, spark):
    docs, _, rows = stages[0]
    scored = quality.classify(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")), keep=["doc_id"])
    assert {r.doc_id for r in rows} == {r.doc_id for r in scored.where("predicted = 1").collect()}
    docs, _, rows = stages[1]
    assert sorted(r.doc_id for r in rows) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    docs, _, rows = stages[2]
    leaked = {r.doc_id for r in decontam.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert sorted(r.doc_id for r in rows) == sorted({r.doc_id for r in docs.select("doc_id").collect()} - leaked)
    docs, _, rows = stages[3]
    taken = {r.doc_id: r.taken for r in mixing.apportion(docs.select("doc_id", "source", "text")).collect()}
    words = {}
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text) if w])
    assert words == {k: v for k, v in taken.items() if v}
    docs, _, rows = stages[4]
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (None, "z z z y"), (3, None)], "doc_id long, text string").withColumn("source", F.lit("s"))
    kept = neardup.keep_one(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (True, 0)]
    real = mixing.realise(docs).collect()
    assert sum(len((r.text or "").split()) for r in real) == sum(r.taken for r in mixing.apportion(docs).collect())

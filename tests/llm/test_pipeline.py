import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import SF001


def test_stages_in_order_and_their_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("rejected", F.lit("x"))
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[-1] > sizes[0] / 3
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    want = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in last.collect()} == want


def test_run_agrees_with_the_stages(spark):
    got = corpus_pipeline.run(spark, SF001)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) > 60

"""The pipeline's stages against brute force, each on its own input."""

import hashlib

import pytest

from tests.llm import brute

pipeline = pytest.importorskip("corpus_pipeline")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf001, tmp_path):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf001}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = texts(docs)
        stage(spark, docs, sf001).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
            after = dict(texts(docs))
        if name == "toxicity":
            assert all(dict(before)[d] == t for d, t in after.items())
            gone = set(dict(before)) - set(after)
            assert sum(labels.get(d, 0) for d in gone) >= 0.5 * sum(labels.values())
            assert sum(labels.get(d) == 0 for d in gone) <= 0.02 * len(before)
        elif name == "line_dedup":
            want = brute.line_dedup(before)
            assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in after.items()} == {d: v[2] for d, v in want.items()}
            assert docs.where("n_chars <> char_length(text)").count() == 0
        elif name == "ngram_jaccard_join":
            assert set(after) == {d for d, v in brute.components(before, 5, 80).items() if v[1] == d}
        elif name == "benchmark_decontamination":
            assert set(after) == {d for d, v in brute.contamination(before, bench).items() if not v[4]}
        else:
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {d for d, _ in before}
            assert docs.selectExpr("sum(length) = sum(if(start = 0, doc_tokens, 0))").first()[0]


def test_stages_on_empty_documents(spark, sf001, tmp_path):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf001).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        assert docs.count() == 0

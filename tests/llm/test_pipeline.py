"""The pipeline's stages against the operators they call."""

import corpus_pipeline
import __spark_entry__ as entry

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append((docs.count(), docs.select("doc_id").distinct().count()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    assert sizes[0][0] == sizes[1][0] > sizes[2][0] and sizes[2][0] == sizes[2][1]
    assert sizes[3][1] == sizes[2][0] <= sizes[3][0] == sizes[4][0]


def test_run_and_registration(spark, sf):
    assert "pipeline" in entry.queries() and len([n for n in entry.queries() if n.startswith("op")]) == 10
    assert entry.queries()["pipeline"](spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf)
        assert docs.count() == 0

import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and {r.doc_id for r in rows} <= ids
    assert all(len(r.ids_sha256) == len(r.decoded_sha256) == 64 for r in rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "bpe"]

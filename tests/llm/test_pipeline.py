"""The pipeline's stages on messy rows, each against its operator's plain meaning, and the whole run."""

import corpus_pipeline
from tests.llm.test_corpus_operators import SCHEMA, brute_components, make_docs


def test_stages(spark, tmp_path):
    rows = [(i, t, lang, s, n) for i, t, lang, s, n, _ in make_docs(80)]
    df = spark.createDataFrame(rows, SCHEMA.rpartition(",")[0])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
    language, distinct, one, mixed, encoded = seen
    assert all(x.columns == df.columns for x in seen[:4])
    texts = [r.text for r in language.collect()]
    assert all(t and any(map(str.isalpha, t)) for t in texts)
    kept = [r.text for r in distinct.collect()]
    assert len(kept) == len(set(kept)) and set(kept) == set(texts)
    parts = brute_components([(r.doc_id, r.text) for r in distinct.collect()])
    assert {r.doc_id for r in one.collect()} == {c for _, c in parts.values()}
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in one.collect()}
    assert encoded.count() == mixed.count()


def test_run(spark, tmp_path):
    spark.createDataFrame([(i, t, lang, s, n) for i, t, lang, s, n, _ in make_docs(40)], SCHEMA.rpartition(",")[0]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA.rpartition(",")[0]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

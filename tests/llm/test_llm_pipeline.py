import corpus_pipeline
from immolens.llm.common import table


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "repeated_passages", "decontamination", "packing"]


def test_pipeline(spark, sf001, tmpdir_path):
    docs = table(spark, sf001, "documents")
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, sf001)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            out.write.parquet(f"{tmpdir_path}/{name}")
            out = spark.read.parquet(f"{tmpdir_path}/{name}")
            assert out.join(given, "doc_id", "left_anti").count() == 0, name
            # no stage but the one for copies may take much
            assert out.count() >= (0.8 if name == "near_duplicates" else 0.9) * given.count(), name
            given = out
    pieces = corpus_pipeline.run(spark, sf001)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {
        r["doc_id"] for r in given.select("doc_id").collect()}


def test_pipeline_of_odd_texts(spark, make_docs, odd_texts, sf001, tmpdir_path):
    given = make_docs(odd_texts)
    columns = given.columns
    for name, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, sf001)
        assert name == "packing" or given.columns == columns
        given.write.parquet(f"{tmpdir_path}/{name}")
        given = spark.read.parquet(f"{tmpdir_path}/{name}")
    assert given.count() > 0


def test_pipeline_of_no_documents(spark, make_docs, sf001, tmpdir_path):
    given = make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, sf001).write.parquet(f"{tmpdir_path}/{name}")
        given = spark.read.parquet(f"{tmpdir_path}/{name}")
    assert given.count() == 0

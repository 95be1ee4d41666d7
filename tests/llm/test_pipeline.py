import corpus_pipeline
from quire.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == columns and 0 < after.count() <= docs.count(), name
        docs = after
    assert all(not any(pii.base(r.text).values()) and r.n_chars == len(r.text) for r in docs.collect())
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert all(r.copies > 0 and r.doc_id in before for r in mixed.collect())


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "a b c", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        at = rows
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
            assert at.count() <= 3


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "pii", "mixing"]

import pytest

import corpus_pipeline
from rowgrove.llm import decontamination, language_id, quality, simhash


@pytest.fixture(scope="module")
def ran(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def test_stages_in_order_and_effective(spark, sf_dir, ran):
    """Each stage is followed by hand from the stage before; the packed documents are those that are left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == columns, name
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[1] == left[0] and left[2] < left[1] and left[3] < left[2] and left[4] < left[3]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = ran.select("doc_id").distinct().collect()
    assert {r.doc_id for r in packed} == ids
    found = simhash.near_duplicates(docs)
    assert found.where("doc_id <> component_id").count() == 0
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontamination.find_contamination(docs, benchmark).where("size(spans) > 0").count() == 0


def test_stages_call_the_operators():
    assert [f for _, f in corpus_pipeline.STAGES[:4]] == [language_id.keep_identified, quality.keep_good, simhash.keep_one_each, decontamination.keep_clean]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_edge_rows(spark, sf_dir, docs_of):
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs_of([None, "", "x", "x"], first_id=10_000).select(*plain.columns)
    docs = plain.limit(300).union(odd).union(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == plain.columns and kept.count() <= docs.count()
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, docs, sf_dir).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert pack(spark, docs.where("false"), sf_dir).count() == 0

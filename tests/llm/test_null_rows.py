"""Rows that are null in every column, and repeated ones, through every operator on documents, pages, turns and vectors."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rowgrove.llm import chat_format, collision_search, decontamination, html_extract, language_id, packing, quality, simhash, token_counts, url_rules

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(60)
    empty = spark.createDataFrame([(None,) * 5] * 2, real.schema)
    return real.union(empty).union(real.limit(3))


def test_documents(spark, docs):
    n = docs.count()
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(None, None), (1, None), (None, "a b"), (2, "")], "item_id long, text string")
    assert token_counts.count_tokens(docs, PATH).where("doc_id IS NULL AND n_tokens = 0 AND NOT over_limit").count() == 2
    found = language_id.identify(docs, language_id.fit(docs), declared="lang", host="source")
    assert found.count() == n and found.where("row.doc_id IS NULL AND lang = 'und' AND NOT accepted").count() == 2
    scored = quality.classify(docs, quality.fit(docs, labels))
    assert scored.count() == n and scored.where("quality IS NULL OR toxic IS NULL OR kept IS NULL").count() == 0
    assert decontamination.find_contamination(docs, benchmark).where("row.doc_id IS NULL AND n_words = 0 AND size(spans) = 0").count() == 2
    near = simhash.near_duplicates(docs)
    assert near.count() == n and near.where("doc_id IS NULL AND print = 0 AND component_id IS NULL").count() == 2
    assert packing.pack_documents(docs, PATH).where("doc_id IS NULL AND length = 1").count() == 2


def test_pages_turns_and_vectors(spark):
    pages = spark.createDataFrame([(None, None, None)] * 2, "page_id long, url string, html string")
    assert [tuple(r) for r in html_extract.extract(pages).collect()] == [(None, None, "", 0)] * 2
    assert [tuple(r) for r in url_rules.judge_urls(pages, url_rules.rule_table(spark)).collect()] == [(None, "", "", None, "allow")] * 2
    turns = spark.createDataFrame([(None, None, None, None)] * 2, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(chat_format.records_of_rows(turns), key="conv_id", record="record")
    assert [(r.conv_id, len(r.turns)) for r in chats.select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()] == [(None, 2)]
    vectors = spark.createDataFrame([(None, None, None), (None, [1.0], 1), (100, None, 1)], "vec_id long, embedding array<float>, label int")
    assert collision_search.nearest(vectors, F.pmod(F.col("vec_id"), F.lit(100)) == 0).count() == 0

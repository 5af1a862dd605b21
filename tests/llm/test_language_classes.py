import pytest
from pyspark.sql import functions as F

from rowgrove.llm import language_id as lang


@pytest.fixture(scope="module")
def skewed(spark):
    """9,000 English rows, then 3 Welsh ones at the end of the file."""
    common = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("the cat sat on the mat and looked at the dog").alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(9_000, 9_003).select(F.col("id").alias("doc_id"), F.lit("mae hen wlad fy nhadau yn annwyl i mi").alias("text"), F.lit("cy").alias("lang"))
    return common.coalesce(1).union(rare.coalesce(1))


def test_a_rare_language_at_the_end_is_a_class(skewed):
    model = lang.fit(skewed)
    assert model.classes == ("cy", "en", "und")
    found = lang.identify(skewed, model, declared="lang").where("row.lang = 'cy'").collect()
    assert [(r.lang, r.accepted) for r in found] == [("cy", True)] * 3


def test_the_sample_is_bounded_by_language(spark, skewed, monkeypatch):
    taken = []
    monkeypatch.setattr(lang, "fit_texts", lambda texts, languages: taken.append(languages))
    lang.fit(skewed)
    lang.fit(skewed, rows=10)
    lang.fit(skewed.withColumn("doc_id", F.lit(None).cast("long")))
    assert [(x.count("en"), x.count("cy")) for x in taken] == [(2_000, 3), (50, 3), (2_000, 3)]


def test_languages_without_letters_are_no_class(spark):
    docs = spark.createDataFrame([(1, "hello there", "en"), (2, "12 34", "xx"), (3, None, "yy"), (4, "été", "fr"), (5, "words", " ")], "doc_id long, text string, lang string")
    assert lang.fit(docs).classes == ("en", "fr", "und")
    assert lang.fit(docs.where("false")).classes == ("und",)

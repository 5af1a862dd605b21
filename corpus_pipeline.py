"""Corpus pipeline: language ID, quality classifier, near-duplicate removal, decontamination, packing.

``run`` applies the stages to ``documents`` one after another; each stage's result is written as Parquet and read again as the
next one's documents, and is deleted as soon as the next one stands. The folder is a new one under ``spark.checkpoint.dir`` of the session (a temporary one only for
a local session where that is unset; a cluster without it is an error).

A document that a stage rejects goes; of near-duplicates the row with the smallest id stays; contaminated documents go. Columns other than those that the
stages read are carried unchanged, whatever their names; the last stage returns pieces of sequences. Null and empty texts have no language and so go with
the first stage, null ids are ids like any other, rows repeated with id and text become one in the near-duplicate stage, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowgrove.functions.paths import delete_folder, scratch
from rowgrove.llm import decontamination, language_id, packing, quality, simhash

STAGES = [
    ("language_id", language_id.keep_identified),
    ("quality_classifier", quality.keep_good),
    ("simhash_near_dedup", simhash.keep_one_each),
    ("benchmark_decontamination", decontamination.keep_clean),
    ("packing", packing.pack_stage),
]

#: SQL can't express the trained stages; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            delete_folder(spark, before)
        before = here
    return docs

"""Training-data pipeline over ``documents``: an ordered list of stages.

Each stage takes what its predecessor kept and calls one operator of
``tillwise.llm``; all but the last return the columns of ``documents``.

Defined results for odd input: null, empty and blank texts fail the quality
rules, so no later stage sees them; repeated rows and near copies leave one
document; rows with a null id go through as documents of their own; a null
source is a source; a very long text is cut into sequences by the packing;
without documents there are no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import mixing, packing, quality_rules, simhash
from tillwise.llm.words import word_count
from tillwise.session import remove_path, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 4-word shingles,
    fingerprints within 4 bits."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draw of the sources' target weights: a document comes as often as
    it is drawn (up to twice), or not at all; the shards are written one by
    one, each in its shuffled order."""
    return mixing.shuffled_shards(mixing.mix(docs, word_count(F.col("text")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences along the curve, one row per piece, ids included."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("mixing", mixture),
          ("packing", pack)]

# Seeded draws, XXH64 fingerprints and a public vocabulary have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the
    shared scratch folder and read again by the next.  A stage's folder goes
    once the next one is written; the last is what the result reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

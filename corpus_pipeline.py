"""A training corpus from documents: language ID, exact dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from seqlab.llm.common import cut, table
from seqlab.llm.queries import MIX_WEIGHTS, labelled_domains, tokenizer_path

#: A text is rejected where its best language saves less than this share of the next one's bytes: above nearly all texts in none of the learned
#: languages and nearly none in them (README, "Language ID in the pipeline").
MIN_MARGIN = 0.03


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the rest, and those without a letter, go."""
    return language_id.keep_known(docs, language_id.fit(docs), min_margin=MIN_MARGIN)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 on five-word shingles connect, that with the smallest id."""
    return jaccard_join.keep_one_each(docs, k=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their rates, so that the domains' expected tokens have the target weights."""
    return mixing.mix(docs, labelled_domains(table(spark, sf_dir, "labels")), MIX_WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    digest = lambda p: p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_documents(docs, tokenizer_path(), end_id=0, derive=digest, lean=True)


STAGES = [("language ID", language), ("exact dedup", exact), ("near duplicates", near), ("mixing", mixed), ("packing", packed)]

#: SQL expresses neither compression, nor fitted rates, nor tokens: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

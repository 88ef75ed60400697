"""Corpus pipeline: toxicity, language, exact copies, near copies, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``docs``, whatever their names.

Defined results, by the operators' own rules: a null text counts as empty; it isn't toxic, but has no language and goes at the language stage, as do texts
without a letter; of equal texts the longest, then the one with the smallest doc_id stays (null ids last); of near copies that with the smallest
doc_id; of repeated rows one stays; texts of any length are treated as a whole; an empty table gives no row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, langid, ngram_join, packing, toxicity
from quire.llm.common import checkpointed, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; learnt from the labels that aren't held out."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(~toxicity.toxic_column(model))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified by a sufficient margin; learnt from those that aren't held out."""
    dictionaries = langid.learn(docs.filter(~held_out()))
    return docs.filter(~langid.rejected_column(dictionaries))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 80 % of their five-word shingles."""
    return ngram_join.representatives(docs, ngram_join.Rule(5, 80))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences; one row per piece."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each cut from the lineage of the ones before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else checkpointed(docs), sf_dir)
    return docs

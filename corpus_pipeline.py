"""The corpus pipeline: quality, language, boilerplate lines, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame, which is
written as Parquet in the shared folder and read back as the docs of the next stage. All but the last
return the columns of documents. Rows with nulls go through each operator's rules, which its docstring states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import langid, lines, packing, quality, simhash
from kinloom.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels outside its held-out fold."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language's centroids, go."""
    return langid.keep_identified(docs, langid.learn(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat on a site and that clearly more than `lines.RATIO` of its documents hold go; the documents stay, and n_chars is counted anew."""
    return lines.drop_boilerplate(docs).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("language ID", keep_identified),
    ("line dedup", drop_boilerplate),
    ("near-duplicates", keep_one_of_each_group),
    ("best-fit packing", pack),
]

#: SQL has no tokenizer, network or XXH64; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of the last, written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

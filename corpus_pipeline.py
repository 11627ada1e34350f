"""The corpus pipeline: five stages, each on all that the one before kept.

1. language ID: documents without a language go.
2. quality rules: documents outside their language's tokeniser-fertility bands go.
3. near duplicates: of each group of near documents the one of least doc_id stays.
4. PII: personal data is replaced in the texts.
5. packing: the documents are placed in packs.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import fertility, langid, ngram_join, packing, pii
from shelfmark.session import drop_tables, tables_noted, written

_tables: list[str] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """As its docs are the result of the stage before, a stage first drops the tables which that one wrote on its way.

    Tables that docs itself reads stay, so stages may be chained without writing what is between.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(_tables, docs)
        with tables_noted(_tables):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; the model is trained on their labels."""
    return langid.kept(docs)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the bands of their language."""
    return fertility.kept(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near documents."""
    return ngram_join.deduplicated(docs)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced."""
    return pii.cleaned(docs)


@_stage
def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in the packs."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("quality rules", quality), ("near duplicates", near_duplicates), ("PII", personal_data), ("packing", packs)]

#: SQL can't express the stages; tests hold each operator, and the stages one after another, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs

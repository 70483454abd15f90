"""A corpus pipeline of five of the operators, from raw documents to packed token sequences."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from oppsearch.llm import (  # noqa: E402
    decontaminate, language_id, packing, pseudonyms, queries, simhash)
from oppsearch.session import ship_package, written  # noqa: E402

#: SQL cannot express the classifier, the tokenizer and XXH64.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or lie between two languages."""
    ship_package(spark)
    model = language_id.train(docs.filter(~F.coalesce(queries.held_out(), F.lit(False))))
    rows = language_id.identify(docs, model, carry={"_row": F.struct(*docs.columns)})
    kept = rows.filter(~language_id.is_rejected())
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return simhash.keep_one_of_each(docs, size=3, max_bits=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced."""
    ship_package(spark)
    return pseudonyms.pseudonymise(docs, queries.SECRET)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequence and offset."""
    ship_package(spark)
    return packing.pack(packing.token_pieces(docs, queries.tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("PII", with_pseudonyms),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs

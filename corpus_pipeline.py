"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Language identification drops texts that it rejects; the shingle join leaves one document of each group of near
copies; decontamination drops documents with benchmark passages; personal data is replaced by its kind; packing
cuts what is left into windows of tokens.

Stages that end in Python write their result themselves, so that workers take whole texts in batches of ``written``'s size
whoever reads it: Spark's own is 10,000 rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framescore.llm.common import documents, written
from framescore.llm.contamination import decontaminated
from framescore.llm.language import recognised
from framescore.llm.ngram_join import one_of_each
from framescore.llm.packing import packed
from framescore.llm.pii import redacted


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised; a null text and one without a letter go, clean ones stay."""
    return written(recognised(docs), "language")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; different texts of one doc_id, and rows without a
    doc_id, all stay."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark, unchanged."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; null texts stay null."""
    return written(redacted(docs), "personal_data")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of the packed sequences; a null or empty text is its end token alone."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", packing)]

#: Models and tokens are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of the documents of ``sf_dir``; an empty table gives none."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = docs if stage in (language, personal_data) else written(docs, name)
    return STAGES[-1][1](spark, docs, sf_dir)

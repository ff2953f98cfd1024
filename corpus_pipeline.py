"""From raw documents to token ids, in five stages.

Every stage works on all that the one before has kept; its result is written as
Parquet and read again. All but the last return the columns of ``documents``,
whatever other columns there are. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from siteoverlap.llm import bpe, decontaminate, jaccard, quality, secrets
from siteoverlap.llm.queries import TOKENIZER
from siteoverlap.llm.textio import stored

#: Documents whose probability of good quality is below this are rejected.
LEAST_QUALITY = 0.5
#: Words of a shingle and percent of similarity from which documents are copies of each other.
SHINGLE, SIMILAR = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of poor quality, row by row (equal texts alike). Null and empty texts are scored as padding; very long ones whole; without labels all stay."""
    return quality.good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), LEAST_QUALITY)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies (equal ids: the smallest hash of the text; no id: last). Null and blank texts all stay; rows equal in id and text stay together."""
    return jaccard.first_of_each_class(docs, SHINGLE, SIMILAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, each row by its own whole text. Null and empty texts stay; without items all stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows the new text. Every row stays; null texts stay null, empty ones empty."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the decoded bytes; a row for each row. Null and empty texts have no ids."""
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("secrets", without_secrets), ("tokens", tokens)]

#: A trained network, edit distances and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

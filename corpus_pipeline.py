"""A training corpus from raw documents: five stages, each written and read again.

quality    drops the documents that the compression classifier rejects (score below 0.3)
lines      removes lines with an earlier match; a document left without words goes
near       keeps one document, that of the smallest id, of each group of near duplicates
mix        takes words from each source near its target; a document taken again is a row more
encode     byte-level BPE ids of every text, as digests, and those of the decoded bytes

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe_codec, line_dedup, mixing, ngram_join, quality
from quire.llm.shared import inner_names, written

LEAST_QUALITY = 0.3


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts score at least ``LEAST_QUALITY``.  Null and empty texts are scored like
    any other, long ones whole; repeated rows stay or go together; without labels every
    score is 0.5 and all stay; an empty table stays empty."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.score(F.col("text"), model) >= LEAST_QUALITY)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that have an earlier match; a document that loses all its
    lines with words goes.  Null, empty and blank texts stay as they are; of rows of equal
    id and text the first keeps its lines."""
    n_lines, n_removed, n_worded = inner_names(docs, 3)
    out = line_dedup.dedup_lines(docs, added=(n_lines, n_removed, n_worded))
    return _recounted(out.filter((F.col(n_worded) > 0) | (F.col(n_removed) == 0)).select(*docs.columns))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, and of several
    rows with it the one of the least text.  Rows without words are like no other and
    stay; so do rows without an id, unless they link with one that has an id."""
    return ngram_join.one_of_each(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each time a document is taken.  Rows without
    words aren't taken; null sources are one source."""
    return _recounted(mixing.mixed_documents(docs))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; a null text counts as empty."""
    return bpe_codec.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", stage_quality), ("lines", stage_lines), ("near", stage_near), ("mix", stage_mix), ("encode", stage_encode)]

#: SQL expresses neither the classifier nor the byte pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

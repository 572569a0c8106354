"""A training corpus from `documents`: five stages, each a table that the next one reads.

1. language ID: documents without a determined language go;
2. line dedup: lines that many documents share stay in one;
3. near-dedup: of each group of near copies the smallest doc_id stays;
4. mixing: sources are brought to their target weights by repeating or leaving out documents;
5. byte-level BPE: every document's ids, and digests of them and of what they decode to.

Each stage takes all rows that the one before kept. Stages 1 to 4 return the columns of `documents`; n_chars follows
the text. Nulls, empty texts, repeated rows and empty tables have the results that the operators state; an
empty table passes through all stages as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.llm import bpe, common, langid, line_dedup, mixing, near_dup

#: Vocabulary and pattern of the last stage.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_determined(docs, *langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.LineIndex(spark).insert(docs).clean_rows(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, RANKS, PATTERN, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The network, the fingerprints and the merges are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

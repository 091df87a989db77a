"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of documents. A stage works on everything that the one before it kept:

1. language ID: texts without a letter, and those whose language stays ambiguous, go;
2. line dedup: repeated lines go, and documents of which nothing else is left;
3. SimHash near-dedup: one document of each component stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. best-fit packing: one row per piece of a document, with its place in a sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontam, langid, linededup, packing, simhash
from docloom.llm._common import saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null, empty and letterless texts go, repeated rows are treated alike, very long texts are judged
    whole, a tie of codewords is ambiguous, and columns with other names come along."""
    return langid.accepted(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines; null and empty texts stay, one that loses all its lines goes, a very long one is a document like any
    other, and columns with other names come along."""
    return linededup.deduplicated(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component; null and empty texts are one, rows that share only an id are different documents, very long texts
    count whole, and columns with other names come along."""
    return simhash.one_of_each(docs, radius=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, very long texts are searched whole, repeated rows are treated
    alike, and columns with other names come along."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places; null and empty texts are an end token alone, long ones several pieces."""
    return packing.pack(docs, "word_bpe_49k.json", capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: Learned models, fingerprint search and alignment are beyond SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Extra columns come along up to the last stage; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``docs`` with their values, whatever they are called; the last returns per document the words that the mix
takes. An empty table gives an empty result in every stage; repeated rows are rows of their own until exact dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import decontam, exact_dedup, langid, mixing, shingles
from tracelake.llm.common import crc_mod, materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: null, empty and letterless texts go, and texts that every learned language codes
    about as long as chance does (``langid.keep_known``). Learns from rows whose crc32 of the id modulo 4 is not 2."""
    return langid.keep_known(docs, langid.train(docs.where(crc_mod("doc_id", 4) != 2)))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id; a null id loses, null counts as the empty text, and of rows
    that tie the one whose columns hash smallest stays."""
    return exact_dedup.keep_one(docs, keep="largest")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts with a five-word Jaccard similarity of 0.8 or more, that with the smallest id;
    a null id loses, ties go by hash (``shingles.keep_one``)."""
    return shingles.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages hit fewer than one word in twenty; texts without words stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all documents: size, size and target of the source, and words taken. A null source is one of its own;
    documents without words take none."""
    return mixing.mix_taken(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Language ID, classes of near-duplicates and the draw of the mix are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token files: language, near duplicates, benchmark passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import Scratch, table
from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.language import keep_identified, learn_profiles
from palimpsest.llm.mixing import mix
from palimpsest.llm.simhash import deduplicate
from palimpsest.llm.tokens import tokenized


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts, texts without a letter, and texts far from every profile."""
    return keep_identified(docs, learn_profiles(docs.select("text", "lang")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: 5-word shingles, Jaccard 0.8 or more.

    SimHash fingerprints link first and are verified; whole sets find the pairs that fingerprints of 64 bits can't reach.
    """
    return deduplicate(docs, width=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture has it."""
    return mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns their index."""
    return tokenized(docs, metadata=("source", "lang"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

#: Fingerprints, n-gram distances, random rounding and the tokenizer are not SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

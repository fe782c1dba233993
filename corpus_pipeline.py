"""The corpus pipeline: quality rules, language ID, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import langid, mixing, near_dups, packing, quality_rules
from marketlens.llm.common import table, written
from marketlens.llm.queries import TOKENIZER, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules; null and empty texts do not, repeated rows pass alike."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a language is found, by automata of the stage's own labelled rows; where no row
    is labelled, rows with a letter."""
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; a row with a null
    id is in no group, and a row that repeats an id and its text goes."""
    return near_dups.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; one that the mix takes twice is there twice. A null source is one."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, repeated ones too, and their places in sequences."""
    return packing.pack(docs, tokenizer_path(TOKENIZER))


STAGES = [("quality rules", quality), ("language ID", language), ("near dedup", dedup), ("mixing", mix), ("packing", pack)]

#: Tokenization and cross-parsing have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))  # once: the next stage reads it several times
    return STAGES[-1][1](spark, docs, sf_dir)

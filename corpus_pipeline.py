"""Corpus preparation in five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner writes it as Parquet and reads it again as the
next one's docs. All but the last return the columns of `documents`, and more columns if the input has more, whatever their
names. An empty table stays empty in every stage. Texts are taken whole, however long. Rows with a null id are documents
like others; rows that repeat an id are, too, except where a stage says otherwise.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seaweft.llm import byte_bpe, mixing, quality_rules, simhash, toxicity
from seaweft.llm.common import read_table, shared_dir
from seaweft.llm.queries import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores at 0.3 or more go; at a tie with 0.3 they go. A null or empty text has no hits and stays."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go: a null or empty text has too few words, and goes."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity of 0.8 or more, tested exactly.

    It is the one with the smallest id (null last; of equal ids the text with the lowest hash, of equal texts one row). Null and
    empty texts are copies of each other.
    """
    return simhash.keep_one(docs, simhash.near_duplicates_wide(docs, shingle=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it: not at all, once or twice.

    A null source is a source; rows of one id and source are taken alike.
    """
    return mixing.repeat(docs, mixing.mix(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, for each copy. A null text has no tokens."""
    return byte_bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_junk), ("simhash", drop_near_duplicates), ("mixing", mix_sources), ("byte_bpe", tokenise)]

#: SQL can't express the lexicon, the forest or the encoder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

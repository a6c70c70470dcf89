"""A corpus pipeline of the operators in ``lacuna.llm``: each stage's rows are the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import cotraining, cube_mix, superminhash, toxicity, vector_pack
from lacuna.llm.common import stored, table
from lacuna.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are judged by language, source and lengths; repeated rows share a verdict.
    Without labels of both kinds nothing can be learnt, and all rows stay or go by the share of good labels.
    """
    return cotraining.accepted(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def calm(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; null and empty texts hold no toxic sentence, repeated rows share a verdict."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on sets of five-word shingles.

    Texts without words link with nothing and stay; of rows with one doc_id one stays; rows without a doc_id all stay.
    """
    return superminhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times.

    A null source is a source of its own; texts without words have size 0 and are taken as often as their source's others.
    """
    return cube_mix.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequence and place; a null or empty text is its end token alone, a repeated row is packed each time."""
    return vector_pack.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", calm), ("near duplicates", distinct), ("mix", mix), ("pack", pack)]

#: Fitted models, sketches, sampling and packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

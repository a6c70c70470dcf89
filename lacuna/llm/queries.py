"""Registered queries of the operators in this package, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import (
    brown, chat_format, cotraining, crosspolytope, cube_mix, gnat, license_scan, merkle_manifest, rp_forest, superminhash, token_count, toxicity, vector_pack,
)
from lacuna.llm.common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on all machines of the cluster."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        from lacuna.llm.common import DEFAULT_TOKENIZERS

        return os.path.join(DEFAULT_TOKENIZERS, name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and inherited license of every document, laid out as a tree of files."""
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return cube_mix.mix(table(spark, sf_dir, "documents"))


def op3_vector_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return vector_pack.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents, on sets of two-word shingles."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a class-based bigram model."""
    return brown.score(table(spark, sf_dir, "documents"))


def op6_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return rp_forest.linked(table(spark, sf_dir, "embeddings"))


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views and combined."""
    views = cotraining.prepared(table(spark, sf_dir, "documents"))
    return cotraining.score_prepared(views, cotraining.fit_prepared(views, table(spark, sf_dir, "labels")))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every twentieth one, by inner product."""
    return crosspolytope.search(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what the parser reads back of them."""
    return chat_format.read_back(chat_format.formatted(chat_format.with_adversary(table(spark, sf_dir, "conversations"))))


def op12_gnat_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, some of whose labels are moved."""
    return gnat.mine(gnat.moved_label(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, and a version for each one tampered with."""
    return merkle_manifest.verify_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_cube_mix, op3_vector_pack, op4_superminhash, op5_brown, op6_rp_forest, op7_cotraining, op8_token_count,
        op9_crosspolytope, op10_toxicity, op11_chat_format, op12_gnat_negatives, op13_merkle_manifest,
    )
}
SQL: dict[str, str] = {"op1_license_scan": license_scan.SQL, "op11_chat_format": chat_format.SQL, "op12_gnat_negatives": gnat.SQL, "op13_merkle_manifest": merkle_manifest.SQL}

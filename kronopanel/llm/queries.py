"""Queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronopanel.llm.leakage import leaked_items
from kronopanel.llm.matching import match_blocks
from kronopanel.llm.packing import pack_documents
from kronopanel.llm.reading_level import fit_levels, reading_levels
from kronopanel.session import table


def _matches(spark: SparkSession, root: str) -> DataFrame:
    return match_blocks(table(spark, root, "raw_blocks"), table(spark, root, "oktmo_reference"), table(spark, root, "consumption"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _matches(spark, root).select("block_id", "territory_id")


def p3_matches(spark: SparkSession, root: str) -> DataFrame:
    """Every matched block with its territory and the confidence of the match."""
    return _matches(spark, root)


def p6_sequences(spark: SparkSession, root: str) -> DataFrame:
    """Every document's place in the training sequences."""
    return pack_documents(table(spark, root, "documents"))


def p6_fill_profile(spark: SparkSession, root: str) -> DataFrame:
    """How full the sequences are: number of sequences by hundredth of the capacity used."""
    used = pack_documents(table(spark, root, "documents")).where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("n_tokens").alias("used"))
    return used.groupBy(F.ceil(F.col("used") * 100 / 2048).alias("percent")).agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


def p7_leaks_by_item(spark: SparkSession, root: str) -> DataFrame:
    """Which test items leaked, into how many documents, and how much of them."""
    found = leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("held"), 4).alias("most_held"), F.count_if("has_answer").alias("with_answer"))


def _levels(spark: SparkSession, root: str) -> DataFrame:
    return reading_levels(table(spark, root, "documents"), fit_levels(table(spark, root, "reading_samples")))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _levels(spark, root).where("level >= 5").select("doc_id")


def p8_document_levels(spark: SparkSession, root: str) -> DataFrame:
    """Level and score of every document."""
    return _levels(spark, root)


def p8_level_profile(spark: SparkSession, root: str) -> DataFrame:
    """The corpus by level: documents and words."""
    return _levels(spark, root).groupBy("level").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"))


QUERIES = {
    "p3_found": p3_found,
    "p3_matches": p3_matches,
    "p6_sequences": p6_sequences,
    "p6_fill_profile": p6_fill_profile,
    "p7_found": p7_found,
    "p7_leaks_by_item": p7_leaks_by_item,
    "p8_found": p8_found,
    "p8_document_levels": p8_document_levels,
    "p8_level_profile": p8_level_profile,
}

#: Tokenising, latent retrieval and learned models are beyond SQL; tests compare them with brute force.
ORACLE: dict[str, str] = {}

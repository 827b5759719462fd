"""Queries of the llm subpackage, for the driver's entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import clusters, leaks, names, neighbours, pairs, reading, splitting, tokenizer
from graphloom.session import table

#: The query rows of a search: every owner whose hash is divisible by 50.
ONE_IN_FIFTY = "pmod(xxhash64(owner_id), 50) = 0"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.mutual_pairs(table(spark, sf_dir, "vectors"))


def p2_most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.most_similar(table(spark, sf_dir, "vectors"), 10, ONE_IN_FIFTY)
    return near.select("space", "owner", "other", F.round("cosine", 6).alias("cosine"), "rank")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "vectors")).select("owner_id", "cluster_key")


def p3_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.describe_clusters(table(spark, sf_dir, "vectors"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"))


def p4_content_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_by_content(table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf_dir, "results"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_names(table(spark, sf_dir, "nodes"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p2_found, p2_most_similar, p3_found, p3_described, p4_found, p4_content_defined, p5_found, p6_found, p7_ids, p8_found, p9_found]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}

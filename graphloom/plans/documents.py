"""Queries over documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import chunking, extraction
from graphloom.plans.registry import query
from graphloom.session import table

STRIP = "regexp_replace({}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"
DEDUP = f"""docs AS (SELECT 'doc-' || md5(content) AS hash, any_value(content) AS content, min(doc_id) AS first_id, count(*) AS copies
    FROM (SELECT doc_id, {STRIP.format("text")} AS content FROM documents) WHERE content <> '' GROUP BY 1)"""
TOKENS = "list_filter(string_split_regex(coalesce({}, ''), '[ \\t\\r\\n]+'), lambda t: t <> '')"
WINDOWS = f"""{DEDUP}, tok AS (SELECT hash, {TOKENS.format("content")} AS t FROM docs),
  win AS (SELECT hash, t, unnest(range(0, len(t), 48)) AS start FROM tok WHERE len(t) > 0),
  chunked AS (SELECT hash, CAST(start // 48 AS INTEGER) AS pos, CAST(len(t[start + 1 : start + 64]) AS INTEGER) AS tokens, array_to_string(t[start + 1 : start + 64], ' ') AS content FROM win)"""


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.dedup_documents(table(spark, sf_dir, "documents"))


@query(f"WITH {DEDUP} SELECT hash, first_id, copies FROM docs")
def doc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir).select("hash", "first_id", "copies")


@query(
    f"""SELECT doc_id, md5(regexp_replace(lower(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
    '[\\x00-\\x1f\\x7f-\x9f]', '', 'g'), '[^A-Za-z0-9 ]', ' ', 'g')), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')) AS cleaned FROM documents"""
)
def clean_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean(F.col("text"))).alias("cleaned"))


@query(f"WITH {WINDOWS} SELECT hash, pos, tokens, md5(content) AS content FROM chunked")
def chunk_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.token_windows(deduped(spark, sf_dir)).withColumn("content", F.md5("content"))


@query(f"WITH {WINDOWS} SELECT count(*) AS chunks, count(DISTINCT 'chunk-' || md5(content)) AS ids, round(avg(tokens), 6) AS avg_tokens, min(tokens) AS min_tokens, max(tokens) AS max_tokens, CAST(sum(tokens) AS BIGINT) AS sum_tokens FROM chunked")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = chunking.token_windows(deduped(spark, sf_dir)).withColumn("id", tx.hash_id("chunk-", F.col("content")))
    return windows.agg(
        F.count("*").alias("chunks"),
        F.countDistinct("id").alias("ids"),
        F.round(F.avg("tokens"), 6).alias("avg_tokens"),
        F.min("tokens").alias("min_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.sum("tokens").alias("sum_tokens"),
    )


@query()
def chunk_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.separator_chunks(deduped(spark, sf_dir)).withColumn("content", F.md5("content"))


@query(
    f"""WITH {DEDUP}, numbered AS (SELECT hash, row_number() OVER (ORDER BY first_id) - 1 AS num, count(*) OVER () AS n FROM docs)
    SELECT hash, num >= n - CAST(floor(n * 0.2) AS BIGINT) AS is_new FROM numbered"""
)
def incremental_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_increment(deduped(spark, sf_dir).select("hash", "first_id"), 0.2, "first_id").select("hash", "is_new")


@query(
    f"""WITH {WINDOWS}, fresh AS (SELECT * FROM chunked WHERE hash NOT IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL)),
    top AS (SELECT coalesce(max(chunk_index), -1) + 1 AS base FROM chunks)
    SELECT hash, pos, tokens, base + row_number() OVER (ORDER BY hash, pos) - 1 AS chunk_index FROM fresh, top"""
)
def incremental_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "chunks")
    fresh = chunking.token_windows(chunking.new_documents(deduped(spark, sf_dir), known)).select("hash", "pos", "tokens")
    base = known.agg(F.coalesce(F.max("chunk_index"), F.lit(-1)) + 1).first()[0]
    return chunking.running_index(fresh, "hash", "pos", start=base)


MENTIONS = "ment AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z]{10,}')) AS entity FROM chunks WHERE chunk_id IS NOT NULL)"


@query(f"WITH {MENTIONS} SELECT chunk_id, entity FROM ment")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.mentions(table(spark, sf_dir, "chunks"))


@query(
    """WITH c AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(content), '[a-z]{10,}') AS w FROM chunks WHERE chunk_id IS NOT NULL),
    p AS (SELECT chunk_id, w[i] AS subject, w[i + 1] AS object FROM (SELECT chunk_id, w, unnest(range(1, len(w))) AS i FROM c))
    SELECT subject, 'co_occurs' AS predicate, object, count(*) AS weight, count(DISTINCT chunk_id) AS n_chunks FROM p WHERE subject <> object GROUP BY 1, 2, 3"""
)
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.triples(table(spark, sf_dir, "chunks"))
    return found.groupBy("subject", "predicate", "object").agg(F.count("*").alias("weight"), F.countDistinct("chunk_id").alias("n_chunks"))


@query("SELECT DISTINCT src, dst, coalesce(weight, 1.0) AS weight FROM edges WHERE src <> '' AND dst <> ''")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as delimited records and read back."""
    edges = table(spark, sf_dir, "edges").distinct()
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    record = F.concat(F.lit('("relationship"<|>'), field("src"), F.lit("<|>"), field("dst"), F.lit("<|>about<|>kind<|>"), field("weight"), F.lit(")"))
    return extraction.parse_relations(edges.select(record.alias("record"))).select("src", "dst", "weight").distinct()


@query(
    """SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props))"""
)
def parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.json_fields(table(spark, sf_dir, "events"), "event_id", "props")


@query("SELECT chunk_id, count(*) AS copies, coalesce(max(chunk_index), -1) AS chunk_index FROM (SELECT DISTINCT * FROM chunks) GROUP BY 1")
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").distinct()
    return rows.groupBy("chunk_id").agg(F.count("*").alias("copies"), F.coalesce(F.max("chunk_index"), F.lit(-1)).alias("chunk_index"))

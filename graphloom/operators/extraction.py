"""Entities and relations from chunks: providers, their offline defaults, and reply parsing."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import clean, number_or, strip, token_count

#: A provider maps a batch of texts to one list of strings each; real models are plugged in here.
Provider = Callable[[list[str]], list[list[str]]]


def _terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]{10,})"), F.lit(1))


def mentions(chunks: DataFrame, provider: Provider | None = None) -> DataFrame:
    """(chunk_id, entity): distinct entities of each chunk; offline, words of ten letters and more."""
    rows = chunks.filter("chunk_id is not null").select("chunk_id", "content")
    if provider is None:
        return rows.select("chunk_id", F.explode(_terms(F.col("content"))).alias("entity")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = provider([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([i for i, names in zip(ids, found) for _ in names], pa.string()), pa.array([n for names in found for n in names], pa.string())], ["chunk_id", "entity"])

    named = rows.mapInArrow(run, "chunk_id string, entity string")
    return named.select("chunk_id", clean(F.col("entity"), ascii_only=False).alias("entity")).filter("entity <> ''").distinct()


def triples(chunks: DataFrame) -> DataFrame:
    """(chunk_id, subject, predicate, object): neighbouring terms of a chunk co-occur."""
    rows = chunks.filter("chunk_id is not null").select("chunk_id", _terms(F.col("content")).alias("w")).distinct()
    pairs = rows.select("chunk_id", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("subject"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("object"))).alias("p"))
    return pairs.select("chunk_id", "p.subject", F.lit("co_occurs").alias("predicate"), "p.object").filter("subject <> object")


def valid_triples(rows: DataFrame, column: str = "triple") -> DataFrame:
    """Rows whose array has exactly three parts that are not empty once cleaned, with weight 1."""
    parts = F.transform(column, lambda p: clean(p, ascii_only=False))
    sound = rows.withColumn("_p", parts).filter((F.size(column) == 3) & F.forall("_p", lambda p: p != ""))
    return sound.select("*", F.col("_p")[0].alias("subject"), F.col("_p")[1].alias("predicate"), F.col("_p")[2].alias("object"), F.lit(1.0).alias("weight")).drop("_p")


def _fields(record: Column, delimiter: str) -> Column:
    inside = F.regexp_extract(record, r"(?s)\((.*?)\)", 1)
    return F.transform(F.split(inside, re.escape(delimiter)), lambda p: strip(F.regexp_replace(strip(p), '^"|"$', "")))


def parse_relations(records: DataFrame, column: str = "record", delimiter: str = "<|>") -> DataFrame:
    """(src, dst, description, keywords, weight) of relationship records of at least five fields."""
    rows = records.withColumn("f", _fields(F.col(column), delimiter)).filter((F.size("f") >= 5) & (F.lower(F.col("f")[0]) == "relationship") & (F.col("f")[1] != "") & (F.col("f")[2] != ""))
    last = F.element_at("f", -1)
    return rows.select(F.col("f")[1].alias("src"), F.col("f")[2].alias("dst"), F.col("f")[3].alias("description"), F.col("f")[4].alias("keywords"), number_or(last, 1.0).alias("weight"))


def parse_entities(records: DataFrame, column: str = "record", delimiter: str = "<|>") -> DataFrame:
    """(entity_name, entity_type, description) of entity records of at least four fields."""
    rows = records.withColumn("f", _fields(F.col(column), delimiter)).filter((F.size("f") >= 4) & (F.lower(F.col("f")[0]) == "entity") & (F.col("f")[1] != ""))
    return rows.select(F.col("f")[1].alias("entity_name"), F.col("f")[2].alias("entity_type"), F.col("f")[3].alias("description"))


def json_fields(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, name, value) of the fields of a JSON object; broken JSON has none."""
    parsed = F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"})
    return rows.select(key, F.explode(parsed).alias("key", "value")).select(key, "value", "key")


_PAIR = re.compile(r'"?([A-Za-z_]\w*)"?\s*:\s*("(?:[^"\\]|\\.)*"|[^,}\]]+)')


def repair_json(text: str | None) -> dict:
    """The first balanced object of a model's reply, else its key-value pairs."""
    text = text or ""
    start = text.find("{")
    if start >= 0:
        try:
            return json.JSONDecoder(strict=False).raw_decode(text[start:])[0]
        except ValueError:
            pass
    out: dict = {}
    for name, value in _PAIR.findall(text):
        value = value.strip().strip('"')
        low = value.lower()
        out[name] = {"true": True, "false": False, "null": None}.get(low, int(value) if re.fullmatch(r"-?\d+", value) else float(value) if re.fullmatch(r"-?\d*\.\d+", value) else value)
    return out


def summarise(rows: DataFrame, column: str = "description", least: int = 500, provider: Callable[[Column], Column] | None = None) -> DataFrame:
    """Texts of at least so many tokens are shortened by the provider; offline, to their first sentences."""
    shorten = provider or (lambda c: F.regexp_extract(c, r"(?s)^((?:[^.!?]*[.!?]){1,3})", 1))
    return rows.withColumn(column, F.when(token_count(F.col(column)) < least, F.col(column)).otherwise(shorten(F.col(column))))

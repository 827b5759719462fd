"""Sources and sinks: corpus and question files, results, graphs, and load-or-build state."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.chunking import running_index

CORPUS = T.StructType([T.StructField("title", T.StringType()), T.StructField("context", T.StringType()), T.StructField("id", T.LongType())])
QUESTIONS = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("options", T.MapType(T.StringType(), T.StringType())),
        T.StructField("answer_idx", T.StringType()),
        T.StructField("id", T.LongType()),
    ]
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, content) of a JSON-lines corpus; doc_id is the row number in file order."""
    rows = spark.read.schema(CORPUS).json(path).withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start"), "_n": F.monotonically_increasing_id()})
    return running_index(rows, "_file", "_at", "_n", name="doc_id").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.col("context").alias("content"))


def read_questions(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """Questions of a JSON-lines file; further columns pass through by an extra schema."""
    return spark.read.schema(T.StructType([*QUESTIONS.fields, *(extra.fields if extra else [])])).json(path)


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """JSON-lines sink of answered questions."""
    results.write.mode(mode).json(path)


def pending(questions: DataFrame, answered: DataFrame, key: str = "id") -> DataFrame:
    """Questions without a written result: a broken run goes on where it stopped."""
    return questions.join(answered.select(key).distinct(), key, "left_anti")


def _manifest(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json")
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def is_built(spark: SparkSession, path: str) -> bool:
    place, system = _manifest(spark, path)
    return system.exists(place)


def save_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Write tables as Parquet and, last of all, the manifest that makes them count."""
    counts = {}
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    place, system = _manifest(spark, path)
    out = system.create(place, True)
    out.write(bytearray(json.dumps(counts, sort_keys=True).encode()))
    out.close()
    return counts


def load_or_build(spark: SparkSession, path: str, build: Callable[[], dict[str, DataFrame]], names: list[str], force: bool = False) -> dict[str, DataFrame]:
    """Tables from the folder if they were completed there, else built and written."""
    if force or not is_built(spark, path):
        save_tables(spark, path, build())
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def _xml(c: F.Column) -> F.Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): GraphML elements, one a row; parts 0..3 in order make a document."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">')], "part int, line string")
    tail = spark.createDataFrame([(3, "</graph></graphml>")], "part int, line string")
    own = nodes.select("node_id").filter("node_id is not null").distinct().select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("node_id")), F.lit('"/>')).alias("line"))
    links = edges.groupBy("src", "dst").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("w"))
    links = links.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="w">'), F.col("w").cast("string"), F.lit("</data></edge>")).alias("line"))
    return head.unionByName(own).unionByName(links).unionByName(tail)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of text parts that, in name order, are one GraphML document."""
    graphml_lines(nodes, edges).repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML folder or file with one element a line."""
    lines = spark.read.text(path)
    text = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    nodes = lines.select(text(F.regexp_extract("value", '<node id="([^"]*)"', 1)).alias("node_id")).filter("node_id <> ''")
    found = lines.filter("value like '<edge %'")
    part = lambda p: text(F.regexp_extract("value", p, 1))
    return nodes, found.select(part('source="([^"]*)"').alias("src"), part('target="([^"]*)"').alias("dst"), F.regexp_extract("value", '<data key="w">([^<]*)<', 1).try_cast("double").alias("weight"))


def save_tree(links: DataFrame, path: str) -> None:
    """(node_id, parent) rows of a tree: its leaves and its inner nodes in folders of their own."""
    key = lambda c: F.lower(F.trim(c))
    parents = links.filter("parent is not null").select(key(F.col("parent")).alias("_k")).distinct()
    keyed = links.withColumn("_k", key(F.col("node_id")))
    keyed.join(parents, "_k", "left_anti").drop("_k").write.mode("overwrite").parquet(f"{path}/leaves")
    keyed.join(parents, "_k", "left_semi").drop("_k").write.mode("overwrite").parquet(f"{path}/inner")


def load_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(leaves, inner nodes) of a saved tree."""
    return spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/inner")

"""Context assembly: budgets, sections and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import tokens


def truncate(c: Column, n: int) -> Column:
    """The first n tokens of a text."""
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def csv_line(*columns: Column) -> Column:
    """Values quoted, numbers bare, between comma and tab."""
    return F.concat_ws(",\t", *columns)


def budget_groups(rows: DataFrame, budget: int, order: list[str], tokens_col: str, by: list[str]) -> DataFrame:
    """Rows with ``group_no``: in order, a group takes rows as long as they fit; a row over the budget is a group of its own.

    by: the groups that are packed independently; each is folded as one array of sizes.
    """
    sizes = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(tokens_col).alias("_t")))), lambda s: s["_t"])
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, size: Column) -> Column:
        fits = (state["used"] + size <= budget) | (F.size(state["out"]) == 0)
        number = F.when(fits, state["g"]).otherwise(state["g"] + 1)
        return F.struct(F.when(fits, state["used"] + size).otherwise(size.cast("bigint")).alias("used"), number.alias("g"), F.concat(state["out"], F.array(number)).alias("out"))

    folded = rows.groupBy(*by).agg(F.aggregate(sizes, start, step)["out"].alias("_g"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_at", at).join(folded, by).withColumn("group_no", F.col("_g")[F.col("_at") - 1]).drop("_g", "_at")


def sectioned(retrieval: DataFrame, summaries: DataFrame, chunk_sizes: DataFrame, limit: int = 4_000) -> DataFrame:
    """(query_id, section, n, size): sections of a query's context under a character limit.

    One community a level from the top level down (3,000 characters each), at most 150
    entities, and chunks in order as long as the rest of the limit lasts.
    retrieval: ranked rows; summaries: (id, level, summary); chunk_sizes: (id, size).
    """
    top = retrieval.filter("kind = 'community'").join(summaries, "id")
    one = top.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "level").orderBy("pos"))).filter("n = 1")
    communities = one.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.least(F.length(F.coalesce("summary", F.lit(""))), F.lit(3000))).alias("size"))
    entities = retrieval.filter("kind = 'entity' and pos <= 150").groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length("id")).alias("size"))
    used = communities.select("query_id", "size").unionByName(entities.select("query_id", "size")).groupBy("query_id").agg(F.sum("size").alias("before"))
    chunks = retrieval.filter("kind = 'chunk'").join(chunk_sizes, "id").join(used, "query_id", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    running = F.sum("size").over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kept = chunks.withColumn("at", running + F.col("before")).filter(F.col("at") <= limit).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    label = lambda frame, name: frame.select("query_id", F.lit(name).alias("section"), "n", F.col("size").cast("bigint").alias("size"))
    return label(communities, "communities").unionByName(label(entities, "entities")).unionByName(label(kept, "documents"))


def pack_shared(rows: DataFrame, budgets: dict[str, int], by: str = "query_id") -> DataFrame:
    """Rows of several tables, each under its own budget, what one leaves going to the next.

    rows: (by, kind, pos, tokens); kinds are packed in the order of ``budgets``.
    """
    out, left = None, None
    for kind, budget in budgets.items():
        own = rows.filter(F.col("kind") == kind)
        own = own.join(left, by, "left") if left is not None else own.withColumn("spare", F.lit(0).cast("bigint"))
        running = F.sum("tokens").over(Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        kept = own.withColumn("used", running).filter(F.col("used") <= budget + F.coalesce("spare", F.lit(0))).drop("spare")
        spent = kept.groupBy(by).agg(F.sum("tokens").alias("spent"))
        every = rows.select(by).distinct().join(spent, by, "left").select(by, (budget - F.coalesce("spent", F.lit(0))).alias("rest"))
        left = every.select(by, "rest") if left is None else every.join(left, by).select(by, (F.col("rest") + F.col("spare")).alias("rest"))
        left = left.withColumnRenamed("rest", "spare")
        out = kept if out is None else out.unionByName(kept)
    return out.drop("used")

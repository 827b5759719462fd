"""Parent-child links to full hierarchies, by leaf peeling.

Bottom-up, the leaves of what is left are peeled off round by round and send their subtree
sizes to their parents; what can never be peeled lies on a circle of parents.  In reverse peel
order every node then takes depth, root and path from its parent.  Sizes are summed before
they are shuffled; descendants come out as (ancestor, descendant) rows rather than lists, so a
root that holds a third of all nodes makes no huge row.

Defined results: ids agree without regard to letter case and surrounding white space; a null
or blank id is no id; repeated rows count once; a parent that is no node of the table is none;
of several claimed parents of equal date the smallest is taken; a node may be its own parent,
which is a circle of one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

#: White space that may surround an id.
BLANKS = " \t\r\n\x0b\x0c ​﻿"


def id_key(column: Column) -> Column:
    """An id as it is compared; null if blank."""
    return F.nullif(F.lower(F.btrim(column, F.lit(BLANKS))), F.lit(""))


def resolve_parents(node_state: DataFrame, communities: DataFrame) -> DataFrame:
    """(node, node_id, parent): the latest stated parent, else the community that lists the node."""
    stated = node_state.select(id_key(F.col("node_id")).alias("node"), "node_id", id_key(F.col("parent")).alias("parent"), "updated_at").filter("node is not null")
    # the latest date decides; rows without a date are the oldest, and of one date the smallest parent is taken
    newest = stated.groupBy("node", "updated_at").agg(F.min(F.struct(F.col("parent").isNull().alias("none"), "parent", "node_id")).alias("row"))
    latest = newest.groupBy("node").agg(F.max_by("row", F.struct("updated_at")).alias("row")).select("node", "row.node_id", "row.parent")
    ids = latest.select(F.col("node").alias("parent"))
    listing = communities.select(id_key(F.col("community_id")).alias("community"), "members", "sub_communities").filter("community is not null")
    lists = [listing.select("community", F.explode(c).alias("child")) for c in ("members", "sub_communities")]
    claims = reduce(DataFrame.unionByName, lists).select("community", id_key(F.col("child")).alias("node")).filter("node is not null")
    claims = claims.join(ids.withColumnRenamed("parent", "community"), "community", "left_semi").groupBy("node").agg(F.min("community").alias("listed"))
    known = ids.select(F.col("parent").alias("known"))
    own = latest.join(known, F.col("parent") == F.col("known"), "left").select("node", "node_id", F.col("known").alias("own"))
    return own.join(claims, "node", "left").select("node", "node_id", F.coalesce("own", "listed").alias("parent"))


def peel(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(peeled tables by round with subtree size, the residual nodes on circles).

    links: (node, parent), one row a node.  Each round aggregates the active rows by parent
    once, giving both the children still waited for and the sizes newly sent.
    """
    children = links.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("waiting"))
    active = links.join(children, "node", "left").select("node", "parent", F.lit(1).cast("bigint").alias("size"), F.col("waiting").isNull().alias("leaf"))
    rounds: list[DataFrame] = []
    while True:
        active = cut_lineage(active)
        leaves, rest = active.filter("leaf").drop("leaf"), active.filter("not leaf")
        if leaves.isEmpty():
            return rounds, rest.select("node", "parent")
        rounds.append(leaves)
        sent = active.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.sum(F.when(F.col("leaf"), F.col("size")).otherwise(0)).alias("more"), F.sum(F.when(F.col("leaf"), 0).otherwise(1)).alias("waiting")
        )
        active = rest.join(sent, "node", "left").select("node", "parent", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), (F.coalesce("waiting", F.lit(0)) == 0).alias("leaf"))


def hierarchy(links: DataFrame, with_path: bool = True) -> DataFrame:
    """(node, parent, state, root, depth, size[, path]) of every node of (node, parent).

    state: ``tree``, ``cycle`` (on a circle of parents) or ``below_cycle``; for the latter two
    root and path are null and depth is -1; size is the number of nodes in the node's subtree,
    null on a circle.  path: ids from the root to the node.
    """
    rounds, residual = peel(links)
    path = [F.array().cast("array<string>").alias("path")] if with_path else []
    none = [F.lit(None).cast("array<string>").alias("path")] if with_path else []
    done = residual.select(
        "node", "parent", F.lit("cycle").alias("state"), F.lit(None).cast("string").alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("bigint").alias("size"), *none
    )
    for layer in reversed(rounds):
        above = done.select(F.col("node").alias("above"), F.col("state").alias("s"), F.col("root").alias("r"), F.col("depth").alias("d"), *([F.col("path").alias("p")] if with_path else []))
        joined = layer.join(above, F.col("parent") == F.col("above"), "left")
        top, tree = F.col("above").isNull(), F.col("s") == "tree"
        extra = [F.when(top, F.array("node")).when(tree, F.concat("p", F.array("node"))).alias("path")] if path else []
        placed = joined.select(
            "node",
            "parent",
            F.when(top | tree, "tree").otherwise("below_cycle").alias("state"),
            F.when(top, F.col("node")).otherwise(F.col("r")).alias("root"),
            F.when(top, 0).when(tree, F.col("d") + 1).otherwise(-1).alias("depth"),
            "size",
            *extra,
        )
        done = done.unionByName(cut_lineage(placed))
    return done


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every tree node, from the paths of ``hierarchy``."""
    steps = tree.filter("state = 'tree'").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return steps.filter("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def found_hierarchy(node_state: DataFrame, communities: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, state) of every node, ids as written in node_state."""
    links = cut_lineage(resolve_parents(node_state, communities))
    tree = hierarchy(links.select("node", "parent"), with_path=False)
    names = links.select("node", "node_id")
    roots = names.select(F.col("node").alias("root"), F.col("node_id").alias("root_id"))
    named = tree.join(names, "node").join(roots, "root", "left")
    return named.select("node_id", F.coalesce("root_id", F.lit("")).alias("root_id"), F.col("depth").cast("int").alias("depth"), "state")

"""Incremental state: latest-wins upserts, signatures, affected sets and assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import id_key

BITS = 62


def latest(rows: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    """One row for each key: the last by the given columns, nulls first; of equal ones the greatest row."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(*newest, *[c for c in rest if c not in newest])).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """State with the changes' rows in place of those of the same key."""
    return state.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def community_signatures(node_state: DataFrame, mode: str = "average") -> DataFrame:
    """(community, signature, n): each bit by the members' average of at least a half, or by strict majority vote."""
    rows = latest(node_state.select("node_id", "parent", "signature", "updated_at"), ["node_id"], "updated_at")
    rows = rows.select(id_key(F.col("parent")).alias("community"), "signature").filter("community is not null and signature is not null")
    ones = [F.sum(F.shiftright("signature", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(BITS)]
    counted = rows.groupBy("community").agg(F.count("*").alias("n"), *ones)
    value = F.lit(0).cast("bigint")
    for i in range(BITS):
        on = F.col(f"b{i}") * 2 >= F.col("n") if mode == "average" else F.col(f"b{i}") * 2 > F.col("n")
        value = value + F.when(on, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return counted.select("community", value.alias("signature"), "n")


def assign_by_signature(nodes: DataFrame, communities: DataFrame, capacity: int, reach: int = 16) -> DataFrame:
    """(node, community, distance): nodes to the community of the closest signature, within a capacity.

    Signatures are compared only where one of eight 8-bit parts agrees, so no node meets all
    communities.  In rounds every free signature proposes to its closest communities with room,
    as many as its nodes fill, which accept their closest proposers, until none within reach has
    room.  Nodes left over come out with a null community.
    """
    from graphloom.operators.capacity import PATIENCE, accept, before, members_placed
    from graphloom.session import cut_lineage

    part = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftright(c, 8 * i).bitwiseAND(F.lit(255)).alias("p")) for i in range(8)]))
    members = nodes.groupBy("node").agg(F.min("signature").alias("group")).withColumnRenamed("node", "id")
    left = cut_lineage(members.filter("group is not null").groupBy("group").agg(F.min("id").alias("first"), F.count("*").alias("m")))
    right = communities.select(F.col("community").alias("place"), (F.lit(capacity) - F.col("n")).cast("bigint").alias("room"), F.col("signature").alias("t"), part(F.col("signature")).alias("k"))
    close = left.select("group", part(F.col("group")).alias("k")).join(right, "k").select("group", "place", "room", F.bit_count(F.col("group").bitwiseXOR(F.col("t"))).alias("distance"))
    close = cut_lineage(close.filter((F.col("distance") <= reach) & (F.col("room") > 0)).distinct())
    taken, open_, round_ = None, close, 0
    while True:
        offers = open_.join(left, "group").withColumn("from", before("room", ["group"], "distance", "place"))
        if round_ >= PATIENCE:
            queue = offers.filter("from = 0").select("group", before("m", ["place"], "distance", "first", "group").alias("ahead"))
            offers = offers.join(queue, "group")
        else:
            offers = offers.withColumn("ahead", F.lit(0).cast("bigint"))
        want = F.least(F.col("from") + F.col("room"), F.col("ahead") + F.col("m")) - F.greatest("from", "ahead")
        accepted = cut_lineage(accept(offers.withColumn("want", want).filter("want > 0").select("group", "first", "place", "distance", "want", "room")))
        if accepted.isEmpty():
            break
        taken = accepted if taken is None else taken.unionByName(accepted)
        gone, used = accepted.groupBy("group").agg(F.sum("got").alias("gone")), accepted.groupBy("place").agg(F.sum("got").alias("used"))
        left = cut_lineage(left.join(gone, "group", "left").select("group", "first", (F.col("m") - F.coalesce("gone", F.lit(0))).alias("m")).filter("m > 0"))
        rest = open_.join(used, "place", "left").select("group", "place", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"), "distance").filter("room > 0")
        open_ = cut_lineage(rest.join(left.select("group"), "group", "left_semi"))
        round_ += 1
    return members_placed(members, taken if taken is not None else accepted).select(F.col("id").alias("node"), F.col("place").alias("community"), "distance")


def pack_buckets(buckets: DataFrame, least: int, most: int) -> DataFrame:
    """(bucket, cluster, part_rows): signature buckets, in order, packed into clusters of least..most rows.

    A bucket of at least ``most`` rows is cut into full clusters; smaller ones are merged with
    their successors up to ``most``.  Only bucket sizes (not rows) come to one task.  Clusters
    left under ``least`` are kept and can be told by their size.
    """
    import pandas as pd

    def run(frame: "pd.DataFrame") -> "pd.DataFrame":
        frame = frame.sort_values("bucket")
        out, cluster, held = [], 0, 0
        for bucket, n in zip(frame.bucket, frame.n):
            n = int(n)
            while n >= most:
                if held:
                    cluster, held = cluster + 1, 0
                out.append((bucket, cluster, most))
                cluster, n = cluster + 1, n - most
            if n and held + n > most:
                cluster, held = cluster + 1, 0
            if n:
                out.append((bucket, cluster, n))
                held += n
        return pd.DataFrame(out, columns=["bucket", "cluster", "part_rows"])

    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    return sizes.groupBy("all").applyInPandas(run, "bucket bigint, cluster int, part_rows int")

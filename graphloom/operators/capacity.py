"""Assignment within capacities: groups of equal rows are one entry, whose rows may go to several places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rounds in which every group proposes as if it were alone; later ones also pass over the
#: room that the groups before them at the same place need, so that near copies end in few rounds.
PATIENCE = 20


def before(value: str, part: list[str], *order: str) -> Column:
    """Sum of the value over the rows before this one in its part."""
    rows = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0)).cast("bigint")


def accept(proposals: DataFrame) -> DataFrame:
    """(group, place, distance, got): each place takes its closest proposers while it has room.

    proposals: (group, first, place, distance, want, room); of equal distances the smaller ``first`` goes before.
    """
    got = F.least(F.col("want"), F.col("room") - F.col("ahead"))
    ranked = proposals.withColumn("ahead", before("want", ["place"], "distance", "first", "group"))
    return ranked.select("group", "place", "distance", got.alias("got")).filter("got > 0")


def members_placed(members: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, place, distance) of every member; place is null for members beyond what was taken.

    members: (id, group), taken: (group, place, distance, got).  Members take the places of
    their group in order of id, the closest first; the join is by group and number, so a large
    group is no large key.
    """
    numbered = members.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy("id")).cast("bigint"))
    from_ = taken.withColumn("from", before("got", ["group"], "distance", "place", "got"))
    slots = from_.select("group", "place", "distance", F.explode(F.sequence(F.col("from") + 1, F.col("from") + F.col("got"))).alias("r"))
    return numbered.join(slots, ["group", "r"], "left").select("id", "place", "distance")

"""Grouping vectors into clusters of mutually similar records, by parallel pivots.

Of each level the records with the smallest hashes are candidates, and a candidate is a pivot if
no pivot of smaller hash is similar to it.  Every record is compared with all pivots of its level
at once and is absorbed by the closest one within the similarity.  The result asked for, sets
connected by similar pairs, is coarser than pivot clusters: a record is also compared with the
members of every pivot so near that one of them could be similar to it (the similarity's angle
and the angle of the pivot's farthest member, and the same from the members' centre, which is
nearer to them), and clusters that such a pair connects are merged.
Records that no pivot absorbs are compared with each other in tiles: their lists are laid side by
side in a few long sides, every two sides make a tile, and a record enters the tiles of all sides
with a pivot whose farthest such record could be similar to it.  So no link is lost.  Where
records are spread evenly nothing can be left out, and the tiles take time in the square of the
records that no pivot absorbs.  Medoids are computed from the final clusters: the member nearest
to the mean direction is the one of the greatest sum of cosines.

Members absorbed by one pivot are never compared with each other, so a cluster that holds a
third of all records costs no pairs; a pivot set has at most ``MOST_PIVOTS`` rows a level, and a
long list is split over tasks by its counted rows.  What a task keeps of similar pairs is one
link for each record.  Vectors travel as 16-bit integers, which changes a cosine by less than
1e-5.

Defined results: null, all-zero and shorter vectors take no part, nor do rows without level or
owner_id; repeated rows count once; the key of a group is its smallest owner_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.neighbours import usable
from graphloom.llm.vectors import DIMENSION, sample_units, unit_rows
from graphloom.operators.graph import connected_components
from graphloom.session import cut_lineage, parallelism

MOST_PIVOTS = 4_096
#: Rows read for the centres, as a multiple of the candidates; centres may lie anywhere, their members are measured.
CENTRE_ROWS = 6
#: Rows compared with all pivots at once.
PLACED_ROWS = 1_024
#: Rows of a block asking and of a block asked.
ASK_ROWS, BLOCK_ROWS = 512, 2_048
SPLIT_ROWS = 50_000
#: Sides that the records without a pivot are laid in, and the bounds of a side's rows.
SIDES, LEAST_SIDE, MOST_SIDE = 8, 4_096, 131_072
#: Similar pairs held before they are folded into groups.
HELD_PAIRS = 1 << 20


class Pivots:
    """The pivots of one level: candidates, in order of their hashes, that no pivot before them is similar to."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, least: float, others: np.ndarray | None = None) -> None:
        close = x @ x.T >= least if len(x) else np.zeros((0, 0), bool)
        chosen = np.zeros(len(x), bool)
        for i in range(len(x)):
            chosen[i] = not (close[i, :i] & chosen[:i]).any()
        self.keys, self.x = keys[chosen], x[chosen]
        self.least = least
        centre = self.x.astype(np.float64)
        for part in (x[~chosen], others) if len(self.x) and others is not None else ():
            s = part @ self.x.T
            near = np.flatnonzero(s.max(axis=1) >= least)
            np.add.at(centre, np.argmax(s, axis=1)[near], part[near])
        self.centre = (centre / np.linalg.norm(centre, axis=1, keepdims=True)).astype(np.float32)
        none, ones = np.zeros(len(self.keys), np.int64), np.ones(len(self.keys))
        self.measure(none, ones, none, ones, ones)

    def measure(self, rows: np.ndarray, farthest: np.ndarray, free: np.ndarray, free_farthest: np.ndarray, off_centre: np.ndarray) -> None:
        """Set tasks and sides of each list, and how near a record of elsewhere may have a similar member or free record there."""
        self.parts = np.maximum(1, -(-rows // SPLIT_ROWS))
        self.bound, self.centre_bound = self._reach(farthest), self._reach(off_centre)
        self.free_bound = np.where(free > 0, self._reach(free_farthest), 2.0)
        # lists follow one another in a side until it is full; a list longer than a side has several of its own
        most = int(np.clip(-(-free.sum() // SIDES), LEAST_SIDE, MOST_SIDE))
        self.side, self.span = np.zeros(len(free), np.int64), np.maximum(1, -(-free // most))
        side = filled = 0
        for i, n in enumerate(free.tolist()):
            if filled and filled + n > most:
                side, filled = side + 1, 0
            self.side[i] = side
            filled += n
            if filled > most:
                side, filled = side + int(self.span[i]), 0
        self.sides = int((self.side + self.span).max(initial=0))

    def _reach(self, farthest: np.ndarray) -> np.ndarray:
        angle = np.arccos(np.clip(farthest, -1, 1)) + np.arccos(self.least)
        return np.cos(np.minimum(angle, np.pi)) - 1e-5

    def sides_near(self, s: np.ndarray) -> np.ndarray:
        """(row, side): whether a free record of the side could be similar to the row, by its products with the pivots."""
        near = np.zeros((len(s), self.sides), bool)
        some = s >= self.free_bound
        for step in range(int(self.span.max(initial=0))):
            own = np.flatnonzero(self.span > step)
            to = self.side[own] + step
            starts = np.flatnonzero(np.r_[True, np.diff(to) > 0])
            near[:, to[starts]] |= np.logical_or.reduceat(some[:, own], starts, axis=1)
        return near


def choose_pivots(rows: DataFrame, least: float) -> dict[int, Pivots]:
    """Pivots of each level: of about twice the square root of its rows, the smallest hashes first."""
    spread = 1 << 30
    place = F.pmod(F.xxhash64("vec"), F.lit(spread))
    # copies make no pivots, and the smallest hash is one however few there are
    sizes = rows.groupBy("level").agg(F.approx_count_distinct("vec").alias("n"), F.min(place).alias("first")).collect()
    limit, last = F.lit(-1), {}
    for r in sizes:
        want = min(MOST_PIVOTS, int(2 * r["n"] ** 0.5) + 8)
        last[r["level"]] = max(r["first"], int(min(1.0, want / r["n"]) * spread))
        limit = F.when(F.col("level") == r["level"], F.lit(max(r["first"], int(min(1.0, CENTRE_ROWS * want / r["n"]) * spread)))).otherwise(limit)
    picked = rows.filter(place <= limit).select("level", "vec", place.alias("place"), "embedding").distinct().collect()
    pivots = {}
    for level in sorted(r["level"] for r in sizes):
        own = sorted((r for r in picked if r["level"] == level), key=lambda r: r["vec"])
        x, candidate = sample_units([r["embedding"] for r in own]), np.array([r["place"] <= last[level] for r in own])
        pivots[level] = Pivots(np.array([r["vec"] for r in own], np.int64)[candidate], x[candidate], least, x[~candidate])
    return pivots


def _measure(rows: DataFrame, pivots: dict[int, Pivots], least: float) -> None:
    """Count every pivot's list and find its farthest member and free record, in one pass; one row a pivot comes back."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # for each pivot and for members and free records apart
        held = {level: (np.zeros((2, len(p.keys)), np.int64), np.ones((2, len(p.keys)))) for level, p in shared.value.items()}
        wide = {level: np.ones(len(p.keys)) for level, p in shared.value.items()}
        for batch in batches:
            levels = np.asarray(batch.column(0))
            at, x = unit_rows(batch.column(1))
            for level, p in shared.value.items():
                own = np.flatnonzero(levels[at] == level)
                for part in np.array_split(own, -(-len(own) // PLACED_ROWS)) if len(own) else ():
                    s = x[part] @ p.x.T
                    best = np.argmax(s, axis=1)
                    top = s[np.arange(len(part)), best]
                    free = (top < least).astype(np.intp)
                    np.add.at(held[level][0], (free, best), 1)
                    np.minimum.at(held[level][1], (free, best), top)
                    member = np.flatnonzero(top >= least)
                    np.minimum.at(wide[level], best[member], np.einsum("ij,ij->i", x[part[member]], p.centre[best[member]]))
        for level, (n, low) in held.items():
            free, some = np.nonzero(n)
            fields = [np.full(len(some), level, np.int32), some.astype(np.int32), free.astype(np.int32), n[free, some], low[free, some], wide[level][some]]
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in fields], ["level", "list", "free", "n", "low", "wide"])

    found = rows.select("level", "embedding").mapInArrow(run, "level int, list int, free int, n bigint, low double, wide double")
    found = found.groupBy("level", "list", "free").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.min("wide").alias("wide")).toPandas()
    for level, p in pivots.items():
        own = found[found.level == level]
        n, low, wide = np.zeros((2, len(p.keys)), np.int64), np.ones((2, len(p.keys))), np.ones((2, len(p.keys)))
        n[own["free"], own["list"]], low[own["free"], own["list"]], wide[own["free"], own["list"]] = own["n"], own["low"], own["wide"]
        p.measure(n[0], low[0], n[1], low[1], wide[0])


def packed_units(x: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit integers."""
    return np.rint(x * (32767 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30))).astype(np.int16)


def unpacked_units(packed: np.ndarray) -> np.ndarray:
    x = packed.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(packed: np.ndarray, sent: np.ndarray) -> pa.Array:
    """Rows as a binary column, empty where not ``sent``."""
    ends = np.cumsum(np.where(sent, packed.shape[1] * packed.itemsize, 0))
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(offsets), pa.py_buffer(packed[sent].tobytes())])


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of all that is not empty, the number of each entry among them)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = DIMENSION * 2
    return np.frombuffer(column.buffers()[2] or b"", np.int16, count=int(offsets[-1]) // 2).reshape(-1, DIMENSION), offsets[:-1] // size


def _local_groups(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest index reachable from each index over the links a-b, by hooking and jumping."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (before == label).all():
            break
    return label


def _similar_to_any(asking: np.ndarray, members: np.ndarray, least: float) -> np.ndarray:
    """Whether each row has a similar member; a row that has found one is asked no further."""
    found = np.zeros(len(asking), bool)
    for m in range(0, len(members), BLOCK_ROWS):
        block = unpacked_units(members[m : m + BLOCK_ROWS])
        rest = np.flatnonzero(~found)
        for q in range(0, len(rest), ASK_ROWS):
            ask = rest[q : q + ASK_ROWS]
            found[ask] = (unpacked_units(asking[ask]) @ block.T).max(axis=1) >= least
    return found


def tile_groups(a: np.ndarray, b: np.ndarray | None, least: float) -> np.ndarray:
    """Group of each row of a, then of b, over the similar pairs of a row of a and one of b; without b, of two rows of a."""
    x, y = unpacked_units(a), None if b is None else unpacked_units(b)
    size, shift = len(a) + (0 if b is None else len(b)), 0 if b is None else len(a)
    other = x if y is None else y
    label, held, count = np.arange(size), [], 0
    for q in range(0, len(x), ASK_ROWS):
        # of two rows of one side the later one is asked
        for m in range(0 if b is not None else q - q % BLOCK_ROWS, len(other), BLOCK_ROWS):
            s = x[q : q + ASK_ROWS] @ other[m : m + BLOCK_ROWS].T
            rows = np.flatnonzero(s.max(axis=1) >= least)
            if not len(rows):
                continue
            row, col = np.nonzero(s[rows] >= least)
            one, two = label[rows[row] + q], label[col + (m + shift)]
            pairs = (one * size + two)[one != two]
            held.append(np.unique(pairs) if len(pairs) > size else pairs)
            count += len(held[-1])
            if count > HELD_PAIRS:
                label, held, count = _folded(label, held), [], 0
    return _folded(label, held) if held else label


def _folded(label: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
    one, two = np.divmod(np.unique(np.concatenate(held)), len(label))
    return _local_groups(label[one], label[two], len(label))[label]


#: What a row does in its list: a member absorbed by the pivot; a visitor; a record within the similarity of
#: the pivot, sent without its vector.  And in its tile: a record of the first and of the second side.
MEMBER, VISITOR, LINKED, FIRST, SECOND = range(5)


def place_rows(levels: np.ndarray, vec: np.ndarray, embeddings: pa.Array, pivots: dict[int, Pivots]) -> Iterator[pa.RecordBatch]:
    """The lists and tiles that each record goes to; a tile of two sides is the list -1 - side, part side."""
    at, x = unit_rows(embeddings)
    for level, p in pivots.items():
        own = np.flatnonzero(levels[at] == level)
        if not len(own):
            continue
        own = own[np.unique(vec[at[own]], return_index=True)[1]]
        for part in np.array_split(own, -(-len(own) // PLACED_ROWS)):
            every, keys = np.arange(len(part)), vec[at[part]]
            s = x[part] @ p.x.T
            best = np.argmax(s, axis=1)
            absorbed = s[every, best] >= p.least
            home, free = np.flatnonzero(absorbed), np.flatnonzero(~absorbed)
            near = s >= p.bound
            near[home, best[home]] = False
            visitor, to = np.nonzero(near)
            linked = s[visitor, to] >= p.least
            could = linked | (np.einsum("ij,ij->i", x[part[visitor]], p.centre[to]) >= p.centre_bound[to])
            visitor, to, linked = visitor[could], to[could], linked[could]
            # a member lies in one part of a long list, a visitor meets every part
            times = np.where(linked, 1, p.parts[to])
            number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            visitor, to, linked = (np.repeat(v, times) for v in (visitor, to, linked))
            side = p.side[best[free]] + keys[free] % p.span[best[free]]
            tiles = p.sides_near(s[free])
            tiles[np.arange(len(free)), side] = True
            tile, other = np.nonzero(tiles)
            low, high = np.minimum(side[tile], other), np.maximum(side[tile], other)
            row = np.r_[home, visitor, free[tile]]
            lists = np.r_[best[home], to, -1 - low]
            number = np.r_[keys[home] % p.parts[best[home]], number, high]
            role = np.r_[np.full(len(home), MEMBER), np.where(linked, LINKED, VISITOR), np.where(side[tile] == low, FIRST, SECOND)]
            fields = [pa.array(v.astype(np.int32)) for v in (np.full(len(row), level), lists, number, role)]
            yield pa.RecordBatch.from_arrays([*fields, pa.array(keys[row]), _binary(packed_units(x[part])[row], role != LINKED)], ["level", "list", "part", "role", "vec", "x"])


def connect_rows(frame: pa.Table, pivots: dict[int, Pivots]) -> Iterator[pa.RecordBatch]:
    """(level, src, dst) links of the lists and tiles of one task, at most one for each row."""
    level, place, part, role, vec = (np.asarray(frame.column(c)) for c in ("level", "list", "part", "role", "vec"))
    packed, number = _packed(frame.column("x").combine_chunks())
    order = np.lexsort((role, part, place, level))
    bounds = np.flatnonzero(np.r_[True, (np.diff(level[order]) != 0) | (np.diff(place[order]) != 0) | (np.diff(part[order]) != 0), True])
    for low, high in zip(bounds[:-1], bounds[1:]):
        ids = order[low:high]
        p, of, lists = pivots[int(level[ids[0]])], role[ids], int(place[ids[0]])
        if lists < 0:
            a, b = ids[of == FIRST], ids[of == SECOND]
            if part[ids[0]] == -1 - lists:
                group = tile_groups(packed[number[a]], None, p.least)
            elif len(a) and len(b):
                group = tile_groups(packed[number[a]], packed[number[b]], p.least)
            else:
                continue
            dst = vec[ids]
            src = dst[group]
        else:
            members, visitors = ids[of == MEMBER], ids[of == VISITOR]
            found = _similar_to_any(packed[number[visitors]], packed[number[members]], p.least)
            dst = np.r_[vec[members], vec[visitors[found]], vec[ids[of == LINKED]]]
            src = np.full(len(dst), p.keys[lists])
        apart = src != dst
        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(apart.sum()), level[ids[0]], np.int32)), pa.array(src[apart]), pa.array(dst[apart])], ["level", "src", "dst"])


def similarity_groups(vectors: DataFrame, least: float = 0.80) -> DataFrame:
    """(level, vec, group): the group of every distinct vector that has a similar one; group is a hash."""
    spark = vectors.sparkSession
    rows = _with_level(vectors)
    pivots = choose_pivots(rows, least)
    _measure(rows, pivots, least)
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from place_rows(np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2), shared.value)

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from connect_rows(pa.Table.from_batches(held), shared.value)

    placed = rows.select("level", "vec", "embedding").mapInArrow(place, "level int, list int, part int, role int, vec bigint, x binary")
    spread = placed.repartition(parallelism(spark), "level", "list", "part")
    links = cut_lineage(spread.mapInArrow(connect, "level int, src bigint, dst bigint").distinct())
    # A vector may occur in several levels; its key is made the level's own before linking.
    own = lambda c: F.xxhash64("level", c)
    groups = connected_components(links.select(own("src").alias("src"), own("dst").alias("dst")))
    names = links.select("level", F.explode(F.array("src", "dst")).alias("vec")).distinct()
    return names.withColumn("node", own("vec")).join(groups, "node").select("level", "vec", F.col("component").alias("group"))


def _with_level(vectors: DataFrame) -> DataFrame:
    """(level, owner_id, vec, embedding) of the usable rows of space node."""
    rows = vectors.filter((F.col("space") == "node") & F.col("level").isNotNull())
    keyed = usable(rows.select("space", F.struct("owner_id", "level").alias("owner_id"), "embedding"))
    return keyed.filter("owner_id.owner_id is not null").select(F.col("owner_id.level").alias("level"), F.col("owner_id.owner_id").alias("owner_id"), "vec", "embedding")


def clusters(vectors: DataFrame, least: float = 0.80, smallest: int = 5) -> DataFrame:
    """(owner_id, level, cluster_key) of the records in groups of at least ``smallest`` records."""
    owners = _with_level(vectors).select("level", "vec", "owner_id").distinct()
    # Equal vectors are similar to each other even if no other record is.
    grouped = owners.join(similarity_groups(vectors, least), ["level", "vec"], "left").withColumn("group", F.coalesce("group", F.xxhash64("level", "vec")))
    keys = grouped.groupBy("level", "group").agg(F.min("owner_id").alias("cluster_key"), F.count("*").alias("n")).filter(F.col("n") >= smallest)
    return grouped.join(keys, ["level", "group"]).select("owner_id", "level", "cluster_key")


def describe_clusters(vectors: DataFrame, least: float = 0.80, smallest: int = 5, typical: int = 3) -> DataFrame:
    """(level, cluster_key, size, medoid, typical array<string>): members nearest to the cluster's centre."""
    found = cut_lineage(clusters(vectors, least, smallest))
    rows = _with_level(vectors).dropDuplicates(["level", "owner_id"]).join(found, ["level", "owner_id"])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    width = 64
    sums = rows.withColumn("norm", norm).groupBy("level", "cluster_key").agg(
        F.count("*").alias("size"), *[F.avg(F.col("embedding")[i].cast("double") / F.col("norm")).alias(f"c{i}") for i in range(width)]
    )
    centres = sums.select("level", "cluster_key", "size", F.array(*[f"c{i}" for i in range(width)]).alias("centre"))
    near = rows.withColumn("norm", norm).join(centres, ["level", "cluster_key"]).withColumn(
        "near", F.aggregate(F.zip_with("embedding", "centre", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v) / F.col("norm")
    )
    order = Window.partitionBy("level", "cluster_key").orderBy(F.desc("near"), "owner_id")
    top = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= typical)
    return top.groupBy("level", "cluster_key", "size").agg(
        F.min_by("owner_id", "rank").alias("medoid"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "owner_id"))), lambda s: s["owner_id"]).alias("typical")
    )

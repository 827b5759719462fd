"""The most similar vectors of every vector, by additive quantisation.

The nearest word of a coarse codebook names the inverted list a vector lives in; what it leaves
over is written as a sum of codewords, one from each of many small full-dimensional residual
codebooks, found by a beam search that keeps ``BEAM`` paths, each with its residual, through all
of them.  A query visits the lists of its nearest coarse words, but none that cannot hold
anything near enough.  There pairs are scored from the codes alone: a query's products with all
codewords are one look-up table, a member's score is the sum of the entries its codes name,
and the stored norms turn it into a distance.  Only pairs that pass are reranked on the exact
vectors.

Only codes and 64-bit hashes are shuffled for the search; exact copies of a vector are one
entry of the index, so a huge group of copies costs no pairs.  The codebooks are fitted on a
bounded sample (``SAMPLE_ROWS`` for each space); every row is indexed.

Defined results: null, all-zero and shorter vectors take no part; repeated rows count once; of
equal cosines the smaller owner_id comes first.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.vectors import DIMENSION, sample_units, unit_rows
from graphloom.session import cut_lineage, parallelism

SAMPLE_ROWS = 16_384
CODEBOOKS = 32
CODEWORDS = 16
#: Paths kept after each codebook.
BEAM = 3
PROBES = 3
#: Distances between reconstructions may exceed those expected of a pair by this factor.
SLACK = 1.1
#: Queries and members of one block of an inverted list; longer lists are searched block against block.
QUERY_ROWS, BLOCK_ROWS = 512, 1_024
#: Members whose look-up table entries are summed at a time, so that the sums stay in the cache.
SCORE_ROWS = 128
#: What float32 may be off by in products of unit vectors and words, with room.
ROUNDING = 1e-5
#: Up to so many best words are found by a pass for each of them.
FEW = 8
#: Pairs that a task of the search gathers before it hands them on.
HELD_PAIRS = 65_536
#: A list expected to hold more rows is split over as many tasks as needed; queries visit all its parts.
SPLIT_ROWS, MOST_PARTS = 50_000, 256
#: Candidate pairs up to this count are broadcast for the exact rerank, more are joined by shuffle.
BROADCAST_PAIRS = 1_000_000


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of x; an empty cluster keeps its centroid."""
    k = min(k, len(x))
    centre = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        half = 0.5 * np.einsum("ij,ij->i", centre, centre)
        label = np.concatenate([np.argmax(part @ centre.T - half, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(label[order]) > 0])
        sums = np.add.reduceat(x[order], starts, axis=0)
        centre[label[order][starts]] = sums / np.diff(np.r_[starts, len(x)])[:, None]
    return centre


class AdditiveQuantiser:
    """A coarse codebook and residual codebooks over the full dimension, with beam-search encoding."""

    def __init__(self, first: np.ndarray, books: np.ndarray) -> None:
        self.first = first
        self.half_first = 0.5 * np.einsum("ij,ij->i", first, first)
        self.words = np.ascontiguousarray(books.reshape(-1, books.shape[-1]))
        self.half = (0.5 * np.einsum("ij,ij->i", self.words, self.words)).reshape(len(books), -1)
        self.offsets = np.arange(len(books)) * CODEWORDS
        self.parts = np.ones(len(first), np.int64)

    def split_lists(self, sample: np.ndarray, rows: int) -> None:
        """Parts of each inverted list, by its share of the sample."""
        home = np.argmax(sample @ self.first.T - self.half_first, axis=1)
        expected = np.bincount(home, minlength=len(self.first)) * (rows / max(1, len(sample)))
        self.parts = np.clip(np.ceil(expected / SPLIT_ROWS), 1, MOST_PARTS).astype(np.int64)

    def reached(self, x: np.ndarray, near: np.ndarray, reach: float) -> np.ndarray:
        """Whether a list can hold a vector within this squared distance of a row.

        All that a list holds is nearer to its word than to the row's nearest word, so it is at least
        as far from the row as the plane between the two words.
        """
        words = self.first[near]
        gain = np.einsum("ijk,ik->ij", words, x) - self.half_first[near]
        apart = np.sqrt(((words - words[:, :1]) ** 2).sum(axis=2))
        return gain[:, :1] - gain <= max(reach, 0.0) ** 0.5 * apart + ROUNDING

    def visits(self, near: np.ndarray, vec: np.ndarray, visit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, part of a list, whether the row is stored there) of all that rows visit; visit: which of the near lists, besides the own part."""
        home = near[:, 0] * MOST_PARTS + vec % self.parts[near[:, 0]]
        row, nth = np.nonzero(visit)
        lists = near[row, nth]
        parts = self.parts[lists]
        first = np.repeat(np.cumsum(parts) - parts, parts)
        place = np.repeat(lists * MOST_PARTS, parts) + np.arange(len(first)) - first
        row = np.repeat(row, parts)
        away = place != home[row]
        row, place = np.r_[np.arange(len(near)), row[away]], np.r_[home, place[away]]
        return row, place, np.arange(len(row)) < len(near)

    @classmethod
    def fit(cls, x: np.ndarray, first: int, codebooks: int = CODEBOOKS, seed: int = 7) -> "AdditiveQuantiser":
        coarse, books = kmeans(x, first, 8, seed), np.zeros((codebooks, CODEWORDS, x.shape[1]), np.float32)
        rest, book = x, coarse
        for m in range(codebooks):
            half = 0.5 * np.einsum("ij,ij->i", book, book)
            rest = rest - book[np.argmax(rest @ book.T - half, axis=1)]
            book = kmeans(rest, CODEWORDS, 5, seed + m + 1)
            books[m, : len(book)] = book
        return cls(coarse, books)

    def encode(self, x: np.ndarray, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
        """(packed codes and norms; the nearest coarse words, nearest first)."""
        packed, near = [np.empty(0, self.packing)], [np.empty((0, probes), np.int64)]
        for part in np.array_split(x, max(1, -(-len(x) // 1024))):
            if not len(part):
                continue
            top = _best(part @ self.first.T - self.half_first, min(probes, len(self.first)))
            codes, cost = self.beam(part - self.first[top[:, 0]])
            out = np.empty(len(part), self.packing)
            out["first"], out["codes"] = top[:, 0], codes
            out["left"] = 2 * cost
            full = self.reconstruct(out)
            out["norm"] = np.einsum("ij,ij->i", full, full)
            packed.append(out)
            near.append(top)
        return np.concatenate(packed), np.concatenate([n for n in near if len(n)] or near)

    def beam(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, cost) of the best path of each row, of ``BEAM`` kept after each codebook.

        The cost of a path is half the squared distance of its sum from what is to be written.
        """
        count, dimension = rest.shape
        every, paths = np.arange(count), 1
        cost = 0.5 * np.einsum("ij,ij->i", rest, rest)[None]
        steps = []
        for m, half in enumerate(self.half):
            book = self.words[m * CODEWORDS : (m + 1) * CODEWORDS]
            # rows: the codewords, for each of them the paths
            step = (half[:, None] - book @ rest.T).reshape(CODEWORDS, paths, count)
            step += cost
            step = np.maximum(step, 0, out=step).reshape(-1, count)
            best = _least(step, BEAM)
            cost = step[best, every]
            word, path = np.divmod(best, paths)
            rest = np.take(rest, (path * count + every).ravel(), axis=0)
            rest -= np.take(book, word.ravel(), axis=0)
            steps.append((word, path))
            paths = BEAM
        at = np.argmin(cost, axis=0)
        cost, codes = cost[at, every], np.empty((count, len(steps)), np.uint8)
        for m, (word, path) in reversed(list(enumerate(steps))):
            codes[:, m], at = word[at, every], path[at, every]
        return codes, cost

    @property
    def packing(self) -> np.dtype:
        """Coarse word, codes, squared norm of the reconstruction and of what is left over."""
        return np.dtype([("first", "<u2"), ("codes", "u1", (len(self.half),)), ("norm", "<f4"), ("left", "<f4")])

    def numbers(self, packed: np.ndarray) -> np.ndarray:
        """Rows of ``words`` that a vector is the sum of, besides its coarse word."""
        return packed["codes"] + self.offsets

    def reconstruct(self, packed: np.ndarray) -> np.ndarray:
        out = self.first[packed["first"]]
        for rows in np.ascontiguousarray(self.numbers(packed).T):
            out += np.take(self.words, rows, axis=0)
        return out

    def scores(self, queries: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Products (member, query) of reconstructions, summed from the queries' look-up tables."""
        tables = self.words @ queries.T
        coarse, which = np.unique(members["first"], return_inverse=True)
        total = (self.first[coarse] @ queries.T)[which]
        numbers = np.ascontiguousarray(self.numbers(members).T)
        held = np.empty((min(SCORE_ROWS, len(members)), len(queries)), total.dtype)
        for low in range(0, len(members), SCORE_ROWS):
            part = total[low : low + SCORE_ROWS]
            entry = held[: len(part)]
            for rows in numbers[:, low : low + SCORE_ROWS]:
                part += np.take(tables, rows, axis=0, out=entry, mode="clip")
        return total


def _least(cost: np.ndarray, count: int) -> np.ndarray:
    """Rows of the ``count`` least of each column, least first; cost is float32 and not negative.

    Such floats are ordered as their bits are, so the row's number takes the place of the last
    bits and whole rows are compared at once; costs that differ in these bits alone (one part in
    130,000 for 48 rows) count as equal.
    """
    bits = (len(cost) - 1).bit_length()
    key = cost.view(np.int32) >> bits << bits
    key |= np.arange(len(cost), dtype=np.int32)[:, None]
    out = np.empty((count, cost.shape[1]), np.intp)
    for k in range(count):
        least = key.min(axis=0)
        out[k] = least & ((1 << bits) - 1)
        if k + 1 < count:
            key[out[k], np.arange(len(least))] = np.iinfo(np.int32).max
    return out


def _best(gain: np.ndarray, count: int) -> np.ndarray:
    """Columns of the ``count`` greatest of each row, greatest first."""
    if count <= FEW:
        gain, every, top = gain.copy(), np.arange(len(gain)), []
        for _ in range(count):
            top.append(np.argmax(gain, axis=1))
            gain[every, top[-1]] = -np.inf
        return np.stack(top, axis=1)
    top = np.argpartition(-gain, count - 1, axis=1)[:, :count]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(gain, top, 1), axis=1), 1)


def packed_column(packed: np.ndarray) -> pa.Array:
    """A binary column of packed rows."""
    ends = np.arange(len(packed) + 1, dtype=np.int32) * np.int32(packed.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(ends), pa.py_buffer(packed.tobytes())])


def packed_rows(column: pa.ChunkedArray, packing: np.dtype) -> np.ndarray:
    """The packed rows of a binary column."""
    rows = [np.empty(0, packing)]
    for chunk in column.chunks:
        if len(chunk):
            _, ends, data = chunk.buffers()
            rows.append(np.frombuffer(data, packing, len(chunk), int(np.frombuffer(ends, np.int32)[chunk.offset])))
    return np.concatenate(rows)


def usable(vectors: DataFrame) -> DataFrame:
    """(space, owner_id, vec, embedding): vec is the 64-bit hash that stands for the exact vector."""
    # whether NaN is in a list is null if it is not, but a null is
    most, least, odd = F.array_max("embedding"), F.array_min("embedding"), F.array_contains("embedding", F.lit(float("nan")).cast("float"))
    sound = (F.size("embedding") == DIMENSION) & ((most != 0) | (least != 0)) & ~odd
    return vectors.filter(F.col("space").isNotNull() & F.col("owner_id").isNotNull() & sound).select(
        "space", "owner_id", F.xxhash64("embedding").alias("vec"), "embedding"
    )


def fit_quantisers(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, AdditiveQuantiser]:
    """One quantiser for each space; first codebook of about sqrt(rows) codewords."""
    rows = usable(vectors)
    sized = vectors.filter(F.col("space").isNotNull() & (F.size("embedding") == DIMENSION))
    counts = {r["space"]: r["n"] for r in sized.groupBy("space").agg(F.count("*").alias("n")).collect()}
    spread = 1 << 30
    share = F.lit(None).cast("double")
    for space, n in counts.items():
        share = F.when(F.col("space") == space, F.lit(min(1.0, sample_rows / n))).otherwise(share)
    picked = rows.filter(F.pmod(F.col("vec"), F.lit(spread)) < share * spread).select("space", "embedding", "vec").collect()
    fitted = {}
    for space, n in sorted(counts.items()):
        own = sorted((r for r in picked if r["space"] == space), key=lambda r: r["vec"])
        x = sample_units([r["embedding"] for r in own])
        if len(x):
            fitted[space] = AdditiveQuantiser.fit(x, int(2 ** np.ceil(np.log2(max(4.0, n**0.5)))))
            fitted[space].split_lists(x, n)
    return fitted


def candidate_pairs(vectors: DataFrame, least: float | None, depth: int, probes: int = PROBES, query: str | None = None) -> DataFrame:
    """(space, query, member) hashes of vectors that may be near, from codes alone.

    least: a pair is kept, however many there are, if its reconstructions are no farther apart
    than a pair of this cosine would have them, both leftovers added, and of two query rows of one
    list only one is given as the query; without least, the best ``depth`` of each query and list.  query: SQL condition on owner_id of the query rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    models = fit_quantisers(vectors)
    names = sorted(models)
    shared = spark.sparkContext.broadcast(models)
    asks = F.expr(query) if query else F.lit(True)
    reach = None if least is None else 2 - 2 * least

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces, vec = np.asarray(batch.column(0).to_pylist(), object), np.asarray(batch.column(1))
            ask = np.asarray(batch.column(2).fill_null(False).to_numpy(zero_copy_only=False))
            at, x = unit_rows(batch.column(3))
            for number, space in enumerate(names):
                model = shared.value[space]
                own = np.flatnonzero(spaces[at] == space)
                if not len(own):
                    continue
                own = own[np.lexsort((~ask[at[own]], vec[at[own]]))]
                own = own[np.unique(vec[at[own]], return_index=True)[1]]  # copies within the batch, a query before others
                packed, near = model.encode(x[own], probes)
                visit = np.broadcast_to(ask[at[own]][:, None], near.shape)
                if reach is not None:
                    visit = visit & model.reached(x[own], near, reach)
                row, place, home = model.visits(near, vec[at[own]], visit)
                own = own[row]
                flags = home * 2 + ask[at[own]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((place * len(names) + number).astype(np.int32)),
                        pa.array(flags.astype(np.int8)),
                        pa.array(vec[at[own]]),
                        packed_column(packed[row]),
                    ],
                    ["place", "flags", "vec", "codes"],
                )

    entries = rows.select("space", "vec", asks.alias("ask"), "embedding").mapInArrow(encode, "place int, flags tinyint, vec bigint, codes binary")

    # Many lists are gathered to a task; a list longer than a block is compared block by block there.
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        frame = pa.Table.from_batches(held)
        places, flags, vecs = (np.asarray(frame.column(c)) for c in ("place", "flags", "vec"))
        order = np.lexsort((-flags, vecs, places))
        keep = np.r_[True, (np.diff(places[order]) != 0) | (np.diff(vecs[order]) != 0)]  # copies from other batches
        order = order[keep]
        codes = packed_rows(frame.column("codes"), shared.value[names[0]].packing)[order]
        places, flags, vecs = places[order], flags[order], vecs[order]
        bounds = np.flatnonzero(np.r_[True, np.diff(places) != 0, True])
        found, waiting = [], 0
        for low, high in zip(bounds[:-1], bounds[1:]):
            name = names[places[low] % len(names)]
            model = shared.value[name]
            packed, vec = codes[low:high], vecs[low:high]
            size, left = packed["norm"], packed["left"]
            flag = flags[low:high]
            # those that are member and query come first in either
            both = np.flatnonzero(flag == 3)
            members, queries = np.r_[both, np.flatnonzero(flag == 2)], np.r_[both, np.flatnonzero(flag == 1)]
            for qs in range(0, len(queries), QUERY_ROWS):
                q = queries[qs : qs + QUERY_ROWS]
                asked = model.reconstruct(packed[q])
                # two of them are compared once: those before this block have met all of it
                once = reach is not None and qs + len(q) <= len(both)
                for ms in range(qs if once else 0, len(members), BLOCK_ROWS):
                    m = members[ms : ms + BLOCK_ROWS]
                    s = model.scores(asked, packed[m])
                    if reach is not None:
                        # |x - y|^2 within SLACK * (reach + both leftovers), sorted to one comparison
                        s -= 0.5 * (size[q] - SLACK * (reach + left[q]))
                        b, a = np.divmod(np.flatnonzero(s >= 0.5 * (size[m] - SLACK * left[m])[:, None]), len(q))
                        fresh = (b + ms > a + qs) | (b + ms >= len(both)) | (a + qs >= len(both))
                        a, b = a[fresh], b[fresh]
                    else:
                        s /= np.sqrt(np.maximum(size[m], 1e-12))[:, None]
                        some = min(depth + 1, len(m))
                        b = np.argpartition(-s, some - 1, axis=0)[:some].ravel()
                        a = np.tile(np.arange(len(q)), some)
                    a, b = vec[q[a]], vec[m[b]]
                    apart = a != b
                    if apart.any():
                        found.append((name, a[apart], b[apart]))
                        waiting += len(found[-1][1])
                    if waiting >= HELD_PAIRS:
                        yield pairs_batch(found)
                        found, waiting = [], 0
        if found:
            yield pairs_batch(found)

    return entries.repartition(parallelism(spark), "place").mapInArrow(search, "space string, query bigint, member bigint")


def pairs_batch(found: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One batch of pairs found in several lists."""
    spaces = pa.concat_arrays([pa.repeat(pa.scalar(name), len(a)) for name, a, _ in found])
    return pa.RecordBatch.from_arrays([spaces, *(pa.array(np.concatenate([f[k] for f in found])) for k in (1, 2))], ["space", "query", "member"])


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, in double precision, summed from the first dimension to the last."""
    x, y = (np.ascontiguousarray(side.T, np.float64) for side in (x, y))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def with_cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(space, query, member, cosine) of (space, query, member, both vectors)."""
    for batch in batches:
        x, y = (np.asarray(batch.column(k).flatten()).reshape(-1, DIMENSION) for k in (3, 4))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(exact_cosine(x, y), pa.float64())], ["space", "query", "member", "cosine"])


def exact_pairs(vectors: DataFrame, pairs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(space, query, member, cosine) of distinct hash pairs, on the exact vectors."""
    rows = usable(vectors).select("space", "vec", "embedding")
    ids = pairs.select("space", F.explode(F.array("query", "member")).alias("vec")).distinct()
    few = pairs.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    exact = rows.join(F.broadcast(ids) if few else ids, ["vec", "space"], "left_semi").groupBy("vec", "space").agg(F.first("embedding").alias("embedding"))
    side = lambda name: exact.select("space", F.col("vec").alias(name), F.col("embedding").alias(f"{name}_x"))
    joined = pairs.join(side("query"), ["query", "space"]).join(side("member"), ["member", "space"])
    return joined.select("space", "query", "member", "query_x", "member_x").mapInArrow(with_cosine, "space string, query bigint, member bigint, cosine double")


def nearest_owners(vectors: DataFrame, scored: DataFrame, k: int, query: str | None = None) -> DataFrame:
    """(space, owner, other, cosine, rank) from exact hash pairs; copies of a vector are neighbours of cosine 1."""
    rows = usable(vectors).select("space", "vec", "owner_id")
    # Of equal vectors only the k + 1 smallest owners can be among the k nearest of anything, and
    # only vectors that are copied or near another one have neighbours.
    place = F.dense_rank().over(Window.partitionBy("vec", "space").orderBy("owner_id"))
    shown = rows.withColumn("n", place).filter(F.col("n") <= k + 1).groupBy("vec", "space").agg(F.collect_set("owner_id").alias("owners"))
    ids = scored.select("space", F.explode(F.array("query", "member")).alias("vec")).distinct().withColumn("near", F.lit(True))
    shown = shown.join(ids, ["vec", "space"], "left").filter((F.size("owners") > 1) | F.col("near"))
    shown = cut_lineage(shown.select("space", "vec", F.explode("owners").alias("owner_id")))
    # A pair is mutual only if both are among the first of their copies.
    asking = rows.filter(F.expr(query)).distinct() if query else shown
    asking = asking.select("space", F.col("vec").alias("query"), F.col("owner_id").alias("owner"))
    shown = shown.select("space", F.col("vec").alias("member"), F.col("owner_id").alias("other"))
    near = asking.join(scored.filter("query <> member"), ["query", "space"]).join(shown, ["member", "space"]).select("space", "owner", "other", "cosine")
    copies = asking.join(shown.withColumnRenamed("member", "query"), ["query", "space"]).filter("owner <> other").select("space", "owner", "other", F.lit(1.0).alias("cosine"))
    order = Window.partitionBy("owner", "space").orderBy(F.desc("cosine"), "other")
    return near.unionByName(copies).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def drop_shuffles(spark: SparkSession) -> None:
    """Let go of shuffle files that only lead to a checkpoint; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mutual_pairs(vectors: DataFrame, k: int = 10, least: float = 0.97) -> DataFrame:
    """(space, owner_a, owner_b): pairs of at least this cosine, each among the other's k nearest."""
    found = cut_lineage(candidate_pairs(vectors, least, 0).select("space", F.least("query", "member").alias("query"), F.greatest("query", "member").alias("member")).distinct())
    drop_shuffles(vectors.sparkSession)
    scored = exact_pairs(vectors, found).filter(F.col("cosine") >= least)
    scored = cut_lineage(scored.select("space", F.explode(F.array(F.struct("query", "member"), F.struct(F.col("member").alias("query"), F.col("query").alias("member")))).alias("p"), "cosine").select("space", "p.query", "p.member", "cosine"))
    drop_shuffles(vectors.sparkSession)
    near = nearest_owners(vectors, scored, k)
    both = near.groupBy("space", F.least("owner", "other").alias("owner_a"), F.greatest("owner", "other").alias("owner_b")).agg(F.count("*").alias("n"))
    return both.filter("n = 2").select("space", "owner_a", "owner_b")


def most_similar(vectors: DataFrame, k: int = 10, query: str | None = None, depth: int = 32, probes: int = 40) -> DataFrame:
    """(space, owner, other, cosine, rank): the k most similar vectors of each query row."""
    found = cut_lineage(candidate_pairs(vectors, None, depth, probes, query).select("space", "query", "member").distinct())
    return nearest_owners(vectors, exact_pairs(vectors, found), k, query)

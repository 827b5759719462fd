"""Trees of clusters: soft clustering by Gaussian mixtures, balanced k-means, layer by layer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import capacity
from graphloom.session import cut_lineage


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.filter("embedding is not null and size(embedding) > 0").select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def soft_clusters(vectors: DataFrame, reduced: int = 8, ks: tuple[int, ...] = (2, 4, 8, 16), threshold: float = 0.1, seed: int = 42) -> DataFrame:
    """(id, cluster, probability): the Gaussian mixture of least BIC on principal components; a row may be in several clusters."""
    rows = _features(vectors)
    n = rows.count()
    wide = len(rows.first()["features"]) if n else 0
    if n < 3:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(1.0).alias("probability"))
    d = min(reduced, wide, n - 1)
    low = cut_lineage(PCA(k=d, inputCol="features", outputCol="low").fit(rows).transform(rows).select("id", "low"))
    best, model = None, None
    for k in [k for k in ks if k <= max(2, n // 4)]:
        fitted = GaussianMixture(k=k, featuresCol="low", seed=seed, maxIter=30).fit(low)
        free = k * (d + d * (d + 1) / 2) + k - 1
        bic = free * np.log(n) - 2 * fitted.summary.logLikelihood
        if best is None or bic < best:
            best, model = bic, fitted
    scored = model.transform(low).select("id", F.posexplode(vector_to_array("probability")).alias("cluster", "probability"))
    # a row that reaches the threshold nowhere keeps its likeliest cluster
    top = Window.partitionBy("id").orderBy(F.desc("probability"), "cluster")
    return scored.withColumn("n", F.row_number().over(top)).filter((F.col("probability") > threshold) | (F.col("n") == 1)).select("id", "cluster", "probability")


def balanced_clusters(vectors: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(id, cluster): k-means into about n/size clusters, none of more than ``size`` rows; every row with a vector is in one.

    Rows over a cluster's capacity, the farthest first, go in rounds to the nearest cluster
    with room until none is left.  Equal vectors are one entry, which fills as many clusters in
    a round as it needs; ranks are taken by windows, so no cluster is handled row by row.
    """
    rows = _features(vectors)
    n = rows.count()
    k = max(1, -(-n // size))
    if k == 1:
        return rows.select("id", F.lit(0).alias("cluster"))
    centres = np.array(KMeans(k=k, seed=seed, maxIter=20).fit(rows).clusterCenters())
    # fewer distinct vectors than clusters give fewer centres; they are used again
    centres = np.resize(centres, (k, centres.shape[1]))
    # adding 0 makes -0.0 and 0.0 the same
    free = rows.select("id", F.transform(vector_to_array("features"), lambda v: v + F.lit(0.0)).alias("x"))
    free = free.select("id", "x", F.concat_ws("_", F.xxhash64("x"), F.hash("x")).alias("group"))
    members = free.select("id", "group")
    left = cut_lineage(free.groupBy("group").agg(F.min("id").alias("first"), F.first("x").alias("x"), F.count("*").alias("m")).withColumn("ahead", F.lit(0).cast("bigint")))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"group string, first {kind}, place int, distance double, want bigint, room bigint"
    used, taken, round_ = np.zeros(k, int), None, 0
    while used.sum() < n:
        still_open = np.flatnonzero(used < size)
        shared = rows.sparkSession.sparkContext.broadcast((still_open, centres[still_open], size - used[still_open]))
        if round_ >= capacity.PATIENCE:
            nearest = left.withColumn("m", F.lit(1).cast("bigint")).mapInArrow(partial(_proposals, shared), schema).select("group", "first", "place", "distance")
            queue = nearest.join(left.select("group", "m"), "group").select("group", capacity.before("m", ["place"], "distance", "first", "group").alias("ahead"))
            left = left.drop("ahead").join(queue, "group")
        accepted = cut_lineage(capacity.accept(left.select("group", "first", "x", "m", "ahead").mapInArrow(partial(_proposals, shared), schema)))
        for row in accepted.groupBy("place").agg(F.sum("got").alias("n")).collect():
            used[row["place"]] += row["n"]
        taken = accepted if taken is None else taken.unionByName(accepted)
        if used.sum() < n:
            gone = accepted.groupBy("group").agg(F.sum("got").alias("gone"))
            rest = left.join(gone, "group", "left").withColumn("m", F.col("m") - F.coalesce("gone", F.lit(0)))
            left = cut_lineage(rest.filter("m > 0").select("group", "first", "x", "m", F.lit(0).cast("bigint").alias("ahead")))
        round_ += 1
    return capacity.members_placed(members, taken).select("id", F.col("place").alias("cluster"))


def _proposals(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each entry's nearest centres with room, as many as its rows fill after the rows ahead of it; the centres are as few as clusters."""
    numbers, centres, room = shared.value
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.array(batch.column(2).to_pylist(), np.float64)
        m, ahead = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2) if len(centres) * x.size < 5e7 else (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T
        best = np.argmin(d, axis=1)
        alone = ahead + m <= room[best]
        who, where, want = [np.flatnonzero(alone)], [best[alone]], [m[alone]]
        for i in np.flatnonzero(~alone):
            order = np.argsort(d[i], kind="stable")
            end = np.cumsum(room[order])
            part = np.minimum(end, ahead[i] + m[i]) - np.maximum(end - room[order], ahead[i])
            hit = part > 0
            who.append(np.full(hit.sum(), i))
            where.append(order[hit])
            want.append(part[hit])
        who, where = np.concatenate(who), np.concatenate(where)
        columns = [batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array(numbers[where].astype(np.int32)), pa.array(d[who, where]), pa.array(np.concatenate(want)), pa.array(room[where])]
        yield pa.RecordBatch.from_arrays(columns, ["group", "first", "place", "distance", "want", "room"])


def build_layers(leaves: DataFrame, cluster: Callable[[DataFrame], DataFrame], layers: int = 3, least: int = 8) -> DataFrame:
    """(parent, child, layer): clusters of leaves (id, embedding) become the nodes of the next layer, at their mean.

    cluster: (id, embedding) -> (id, cluster).  Stops at a layer of at most ``least`` nodes.
    """
    current, out = cut_lineage(leaves.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))), None
    for layer in range(1, layers + 1):
        if current.count() <= least:
            break
        found = cut_lineage(cluster(current).select("id", F.concat(F.lit(f"T{layer}_"), F.col("cluster").cast("string")).alias("parent")))
        links = found.select("parent", F.col("id").alias("child"), F.lit(layer).alias("layer"))
        out = links if out is None else out.unionByName(links)
        parts = found.join(current, "id").select("parent", F.posexplode("embedding").alias("i", "v")).groupBy("parent", "i").agg(F.avg("v").alias("v"))
        current = cut_lineage(parts.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("embedding")).withColumnRenamed("parent", "id"))
    return out if out is not None else leaves.sparkSession.createDataFrame([], "parent string, child string, layer int")

"""Centroid clustering with exact integer distances that are updated, not recomputed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, settle

#: Beyond it a squared distance of 64 components may not fit a long.
LARGEST = 1 << 27


def finite(vector: str):
    """Column: the vector is there and holds neither null nor non-finite entries."""
    return F.expr(f"`{vector}` is not null and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))")


def whole(vector: str, scale: int, shift: int, least: int, most: int):
    """Column: floor(scale * x) + shift of each x as array<int>; null where one of them leaves least to most."""
    at = f"floor({scale}D * cast(x as double))"
    inside = F.expr(f"forall(`{vector}`, x -> {scale}D * cast(x as double) between {least - shift}D and {most - shift}D)")
    return F.when(inside, F.expr(f"transform(`{vector}`, x -> cast({at} + {shift} as int))"))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a matrix, null rows as zeros, and which rows are there."""
    there = ~np.asarray(column.is_null())
    out = np.zeros((len(column), width), np.int64)
    out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out, there


def _step(state: DataFrame, old: list[list[int]], new: list[list[int]], dims: int) -> DataFrame:
    """state with its dot products moved from the old centroids to the new ones, and the nearest of these."""
    k = len(new)
    first = "dots" not in state.columns
    change = np.array(new, np.int64) - np.array(old, np.int64)
    own = np.array([sum(c * c for c in row) for row in new], np.int64)
    moved = [(j, np.flatnonzero(change[j])) for j in range(k) if change[j].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, there = _matrix(batch.column(1), dims)
            dots = np.zeros((len(x), k), np.int64) if first else _matrix(batch.column(2), k)[0]
            for j, at in moved:
                dots[:, j] += x[:, at] @ change[j, at]
            far = own - 2 * dots
            nearest = far.argmin(1)  # the first of equals
            distance = np.einsum("ij,ij->i", x, x) + far[np.arange(len(x)), nearest]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(dots.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(nearest.astype(np.int32), mask=~there), pa.array(distance, mask=~there)], ["key", "x", "dots", "cluster", "distance"])

    kind = state.schema["key"].dataType.simpleString()
    return state.select(*["key", "x", "dots"][: 2 if first else 3]).mapInArrow(run, f"key {kind}, x array<int>, dots array<long>, cluster int, distance long")


def _means(state: DataFrame, old: list[list[int]], dims: int) -> list[list[int]]:
    """Exact floors of the componentwise means of each cluster; the old centroid where it is empty. One row a cluster comes to the driver."""
    sums = state.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dims)]).collect()
    new = list(old)
    for row in sums:
        new[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return new


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster int, distance long, cluster_inertia long, inertia long, centroid string): integer k-means of the vectors with exactly dims finite components.

    A component x counts as floor(scale * x). The first centroids are the k vectors with the smallest sha256 of `seed:id`; each round assigns all vectors and replaces every
    centroid that has some by the floors of its exact means; then all are assigned once more. centroid: the components of the final centroid, joined by commas.

    Per vector a table keeps the exact dot products with all centroids. A round adds to them the vector's products with the components in which a centroid moved, and takes the
    smallest distance anew (ties: the smaller number). The table is written each round, so a lost executor costs its tasks alone; k rows of sums come to the driver.

    Null vectors and those of another length or with null or non-finite entries have no row. Repeated rows are vectors of their own; equal hashes start in the order of the vectors, and
    null ids start last. Fewer than k vectors: so many centroids. A vector with a component beyond 2**27 / scale, whose squared distances may not fit a long, keeps its row with nulls
    and takes no part; so does an inertia that does not fit. Other columns are left out, whatever their names.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id].dataType
    there = vectors.where(F.size(vector) == dims).where(finite(vector))
    state = there.select(F.col(id).alias("key"), whole(vector, scale, 0, -LARGEST, LARGEST).alias("x"))
    starts = state.where("x is not null").select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    centroids = [list(r["x"]) for r in starts]
    if not centroids:
        return state.select(F.col("key").alias(id), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "string"))])
    held = [[0] * dims for _ in centroids]
    for turn in range(rounds + 1):
        if centroids != held:
            before, state = state, settle(_step(state, held, centroids, dims))
            if turn:
                release(before)
            held = centroids
        if turn < rounds:
            centroids = _means(state, held, dims)
    return _report(spark, state, held, id, kind)


def _report(spark: SparkSession, state: DataFrame, centroids: list[list[int]], id: str, kind: T.DataType) -> DataFrame:
    """The assignment with sums of distances; one row a cluster is broadcast."""
    parts = state.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    fits = lambda n: int(n) if n < 1 << 63 else None
    total = fits(sum(int(r["s"]) for r in parts))
    by = {r["cluster"]: int(r["s"]) for r in parts}
    rows = [(j, fits(by.get(j, 0)), total, ",".join(map(str, c))) for j, c in enumerate(centroids)]
    small = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string")
    return state.select(F.col("key").alias(id), "cluster", "distance").join(F.broadcast(small), "cluster", "left").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid")

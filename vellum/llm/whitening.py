"""Embedding whitening from exact cross-products of bit-sliced integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import _matrix, finite, whole
from .common import settle

INT = (1 << 31) - 1
#: A component whose eigenvalue is a smaller part of the largest is none: its direction would be rounding.
RANK = 1e-11


def _planes(y: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the columns of y, packed across rows into 64-bit words (zeros fill the last), by column; the column and the bit of each plane."""
    n, words = len(y), -(-len(y) // 64)
    column = np.repeat(np.arange(len(bits)), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if len(column) else column
    out = np.zeros((len(column), words * 8), np.uint8)
    for p in range(max(bits, default=0)):
        at = np.flatnonzero(bit == p)
        out[at, : -(-n // 8)] = np.packbits(((y[:, column[at]] >> p) & 1).astype(np.uint8).T, axis=1)
    return out.view(np.uint64), column, bit


def _pair_counts(y: np.ndarray, bits: list[int], into: np.ndarray) -> None:
    """Add to into[s, i, j] (i <= j) how often a bit p of column i and a bit q of column j with p + q = s are set in one row."""
    planes, column, bit = _planes(y, bits)
    for a in range(len(planes)):
        lo = np.searchsorted(column, column[a])  # planes stand by column
        both = np.bitwise_count(planes[a] & planes[lo:]).sum(1, dtype=np.int64)
        into[bit[a] + bit[lo:], column[a], column[lo:]] += both


def scatter(fit: DataFrame, low: list[int], bits: list[int]) -> np.ndarray:
    """Exact sums over the rows of fit of (x_i - low_i) * (x_j - low_j), as a matrix of Python integers.

    A task counts pairs of set bits by the sum of their places; Spark adds the counts up, and the places weigh them on the driver, where dims * dims sums arrive for each of at most
    twice as many places as a component has bits."""
    dims, places = len(low), max(1, 2 * max(bits, default=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((places, dims, dims), np.int64)
        for batch in batches:
            _pair_counts(_matrix(batch.column(0), dims)[0] - np.array(low), bits, counts)
        s, i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (s.astype(np.int32), i.astype(np.int32), j.astype(np.int32), counts[s, i, j])], ["s", "i", "j", "n"])

    out = np.zeros((dims, dims), object)
    for r in fit.mapInArrow(run, "s int, i int, j int, n long").groupBy("s", "i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] += r["n"] << r["s"]
    return np.triu(out) + np.triu(out, 1).T


def _project(x: np.ndarray, n: int, sums: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums as exact integers, and what the centred rows are in the basis."""
    small = n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 61
    z = n * (x if small else x.astype(object)) - sums.astype(np.int64 if small else object)
    return z, (z / n).astype(np.float64) @ basis


def _identity_error(fit: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> float:
    dims, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = _project(_matrix(batch.column(0), dims)[0], n, sums, basis)[1]
            total += w.T @ w
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    rows = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return max(abs(r["v"] / n - (r["i"] == r["j"])) for r in rows)


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component int, n long, deviation long, whitened double, explained double, identity_error double): each vector on the unit eigenvectors of its covariance.

    An entry c counts as x = floor(scale * c) + shift. n distinct x vectors are the fit list. Their cross-products come exactly from AND and popcount over bit planes of x less its
    dimension's least value, are centred as integers (n * C - S S'), and only then become doubles for eigh. The largest entry of an eigenvector is positive.

    Null vectors and those with null or non-finite entries have no row; repeated rows and null ids keep theirs. The fit takes vectors of the commonest length (ties: the longer) whose x
    stay within 32 bits; others keep rows with null deviation and whitened, and so does a deviation that does not fit a long. Components number at most the rank: tables of none or one distinct
    vector have no rows. Other columns are left out, whatever their names. The eigenvectors take dims * dims numbers on the driver, so dims is some thousands at most; rows never go there.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    there = vectors.where(finite(vector)).select(F.col(id).alias("key"), F.col(vector).alias("v"))
    none = spark.createDataFrame([], schema).withColumnRenamed("key", id)
    lengths = there.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return none
    dims = lengths[0]["d"]
    rows = there.select("key", F.when(F.size("v") == dims, whole("v", scale, shift, -INT, INT)).alias("x"))
    fit = settle(rows.where("x is not null").select("x").distinct())
    parts = fit.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("d").collect()
    if not parts or parts[0]["n"] < 2:
        return none
    n, low = parts[0]["n"], [r["low"] for r in parts]
    sums = np.array([r["s"] for r in parts], object)
    products = scatter(fit, low, [(r["high"] - r["low"]).bit_length() for r in parts])
    above = sums - n * np.array(low, object)
    centred = n * products - np.outer(above, above)
    covariance = (centred / (n * n)).astype(np.float64)
    values, unit = np.linalg.eigh(covariance)
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > RANK * max(values[-1], 0)]
    if not order:
        return none
    values, unit = values[order], unit[:, order]
    unit = unit * np.sign(unit[np.abs(unit).argmax(0), np.arange(len(order))])
    basis, explained = unit / np.sqrt(values), values / np.trace(covariance)
    error, k = _identity_error(fit, n, sums, basis), len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                some = batch.slice(lo, 4096)
                x, good = _matrix(some.column(1), dims)
                z, white = _project(x, n, sums, basis)
                wide = z if z.dtype == object or int(np.abs(z).max(initial=0)) ** 2 * dims < 1 << 62 else z.astype(object)
                deviation = (wide * wide).sum(1)
                fits = good & (deviation < 1 << 63).astype(bool)
                deviation = np.where(fits, deviation, 0).astype(np.int64)
                row = np.repeat(np.arange(len(some)), k)
                columns = [some.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))), pa.array(np.full(len(row), n)), pa.array(deviation[row], mask=~fits[row]),
                           pa.array(white.ravel(), mask=~good[row]), pa.array(np.tile(explained, len(some))), pa.array(np.full(len(row), error))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", id)

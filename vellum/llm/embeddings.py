"""Embedding near-dedup by lattice hashing: random projections decoded to E8 points in several tables, neighbouring
points probed, every candidate's cosine verified in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, settle

TABLES, BLOCKS, SCALE, PROBES = 8, 2, 0.25, 4
#: Vectors of one cell that one task compares with each other or with as many more; larger cells are cut to such parts.
CELL_PART = 1000


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of the E8 lattice, doubled so that it is whole."""

    def d8(y):
        r = np.rint(y)
        odd = (r.sum(1).astype(np.int64) & 1).astype(bool)
        d = y - r
        k = np.abs(d).argmax(1)
        rows = np.flatnonzero(odd)
        r[rows, k[rows]] += np.where(d[rows, k[rows]] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(near[:, None], a, b)).astype(np.int64)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = [0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    out += [[1 if m >> i & 1 else -1 for i in range(8)] for m in range(256) if bin(m).count("1") % 2 == 0]
    return np.array(out, np.int64)


ROOTS = _roots()


def projection(table: int, dim: int, seed: int) -> np.ndarray:
    """Orthonormal columns, 8 for each block of the table (fewer than 8 * BLOCKS dimensions: rows of noise), scaled to E8."""
    r = np.random.default_rng([seed, table])
    g = r.normal(size=(max(dim, 8 * BLOCKS), 8 * BLOCKS))
    return np.linalg.qr(g)[0][:dim]


def _key(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(len(points), table + 1, np.uint64)
    for j in range(points.shape[1]):
        h = mix(h ^ (points[:, j].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return h.view(np.int64)


def cells(v: np.ndarray, seed: int = 9, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of unit vectors: (row, cell, own). own is True for the cell where a vector stands, one in each table; the
    others are the next lattice points beside it, nearest first over the table's blocks."""
    n, dim = v.shape
    rows, keys, own = [], [], []
    norms = (ROOTS**2).sum(1) / 4
    shift = np.random.default_rng([seed, 999]).uniform(0, 1, (TABLES, 8 * BLOCKS))
    for t in range(TABLES):
        y = (v @ projection(t, dim, seed)) * np.sqrt(dim / 64) / (SCALE * np.sqrt(dim / 64)) + shift[t]
        points = [e8(y[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)]
        rows.append(np.arange(n))
        keys.append(_key(np.concatenate(points, 1), t))
        own.append(np.ones(n, bool))
        if not probes:
            continue
        gains = np.concatenate([norms - (y[:, 8 * b : 8 * b + 8] - points[b] / 2) @ ROOTS.T for b in range(BLOCKS)], 1)
        best = np.argpartition(gains, probes, 1)[:, :probes]
        for k in range(probes):
            block, root = best[:, k] // 240, best[:, k] % 240
            moved = [points[b] + np.where((block == b)[:, None], ROOTS[root], 0) for b in range(BLOCKS)]
            rows.append(np.arange(n))
            keys.append(_key(np.concatenate(moved, 1), t))
            own.append(np.zeros(n, bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows as unit vectors. Each is first brought to a greatest component of 1, so that no square leaves the range of doubles."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id: str = "vec_id", vector: str = "embedding", seed: int = 9) -> DataFrame:
    """One row for each input row: its id as vec_id, n_links (other rows linked directly), component_id and kept.

    Two rows link when their cosine is at least threshold and the tables bring them together; none is linked below it. Equal vectors
    count as one in the search and each as a row in n_links. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, like vectors of another length. Rows that repeat an id are taken as one each.

    Cells give links only as a forest over each cell's linked rows, so no list of pairs is made; links are then counted
    inside each component, all of whose pairs are compared part by part, which also finds what the tables missed there.
    """
    bad = F.expr(f"{vector} is null or size({vector}) = 0 or exists({vector}, x -> x is null or isnan(x) or abs(x) = double('inf')) or forall({vector}, x -> x = 0)")
    doubles = F.expr(f"transform({vector}, x -> double(x))")
    rows = settle(vectors.select(F.col(id).cast("long").alias("vec_id"), F.when(bad, F.lit(None)).otherwise(doubles).alias("v")))
    good = rows.where("v is not null")
    same = settle(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(lens).tolist():
                for at in np.array_split(np.flatnonzero(lens == dim), max(1, int((lens == dim).sum()) // 2000)):
                    sub = batch.take(pa.array(at))
                    m = _unit(_matrix(sub.column(1)))
                    r, k, o = cells(m, seed)
                    yield pa.RecordBatch.from_arrays([pa.array(mix(k.astype(np.uint64) ^ np.uint64(dim)).view(np.int64)), sub.column(0).take(pa.array(r)), pa.array(o)], ["cell", "rep", "own"])

    probed = settle(same.select("rep", "v").mapInArrow(hashed, "cell long, rep long, own boolean"))
    # cells where someone stands and someone else stands or looks
    busy = probed.groupBy("cell").agg(F.sum(F.col("own").cast("int")).alias("stand"), F.count("*").alias("n")).where("stand > 0 and n > 1")
    met = probed.join(busy.select("cell", "n"), "cell").join(same.select("rep", "v", "copies"), "rep")
    edges = _blocks_of(met, "cell").mapInArrow(_per_block(threshold, _forest), "a long, b long").distinct()
    root = components(settle(edges))
    sizes = root.groupBy("root").agg(F.count("*").alias("n"))
    inside = root.join(sizes, "root").join(same.selectExpr("rep as node", "v", "copies"), "node")
    inside = inside.select(F.col("root").alias("cell"), F.col("node").alias("rep"), F.lit(True).alias("own"), "n", "v", "copies")
    linked = _blocks_of(inside, "cell").mapInArrow(_per_block(threshold, _count), "a long, b long").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    known = same.join(linked, "rep", "left").join(root.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("v", F.expr("coalesce(others, 0) + copies - 1").alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    named = rows.join(known, "v", "left")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _blocks_of(met: DataFrame, cell: str) -> DataFrame:
    """Cells of n rows cut into parts of about CELL_PART, each pair of parts a block of its own; a row goes to every block of its part."""
    cut = F.ceil(F.col("n") / CELL_PART).cast("int")
    part = F.pmod(F.xxhash64("rep"), cut).cast("int")
    dealt = met.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    dealt = dealt.select(cell, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "own", "copies", "v")
    return dealt.repartition(cell, "lo", "hi").sortWithinPartitions(cell, "lo", "hi", "rep")


def _per_block(threshold: float, answer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.slice(table.num_rows - 1, 1)
            same = np.ones(table.num_rows, bool)
            for c in range(3):
                same &= table.column(c).to_numpy() == last.column(c)[0].as_py()
            rest = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last block may go on
            if rest:
                yield from blocks(table.slice(0, rest))
            held = table.slice(rest).to_batches()
        if held:
            yield from blocks(pa.Table.from_batches(held))

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, lo, hi, part, rep, own, copies = (table.column(c).to_numpy(zero_copy_only=False) for c in range(7))
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        v = table.column(7).combine_chunks()
        out_a, out_b = [], []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
            if b - a < 2:
                continue
            m = _unit(_matrix(v.slice(a, b - a)))
            close = m @ m.T >= threshold
            close &= rep[a:b, None] != rep[None, a:b]
            close &= own[a:b, None] | own[None, a:b]
            if lo[a] != hi[a]:
                close &= part[a:b, None] != part[None, a:b]
            if close.any():
                x, y = answer(close, rep[a:b], copies[a:b])
                out_a.append(x)
                out_b.append(y)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def _forest(close: np.ndarray, rep: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked row with the least row that links reach in this block."""
    root = np.arange(len(rep))
    while True:
        new = np.where(close, root[None, :], len(rep)).min(1)
        new = np.minimum(new, root)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(rep)))
    return rep[at], rep[root[at]]


def _count(close: np.ndarray, rep: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each links with in this block."""
    n = close @ copies.astype(np.int64)
    at = np.flatnonzero(n)
    return rep[at], n[at]

"""Indexes over vectors: an inverted file of cells for nearest neighbours, and hash tables for pairs above a cosine."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.vectors import BLOCK, LEAST, TALL, WIDE, Nearest, _cosines, _frame, _matrix, _named, _parts, _sides, _slack
from vellum.sources.scratch import settle

#: Most cells of an index: centroids are held by the driver and by every worker.
MOST_CELLS = 1024


class Cells(NamedTuple):
    """filed (id, v, cell): every row in the cell of its nearest centroid. radius: largest angle in each cell between a row and its centroid; rows: how many it has."""

    filed: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; the first centroids are rows spread over the sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def _slices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the parts, TALL at a time: a worker holds the cosines of so many with all centroids."""
    for p in parts:
        for s in range(0, len(p), TALL):
            yield p.iloc[s : s + TALL]


def build_cells(items: DataFrame, id: str = "id", vector: str = "embedding", cells: int | None = None, sample_rows: int = 20_000, rounds: int = 8) -> Cells:
    """The inverted file of all items with a vector. Centroids (about the root of the number of rows, MOST_CELLS at most) are fitted on about sample_rows rows, chosen by a bound on a hash of
    the id; every row is filed."""
    it = _named(items, id, vector)
    n = it.count()
    if not n:
        return Cells(it.withColumn("cell", F.lit(0)), np.zeros((1, 1)), np.zeros(1), np.zeros(1, np.int64))
    some = it if n <= sample_rows else it.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) < int((1 << 40) * sample_rows / n))
    sample = _matrix(pd.Series([r["v"] for r in sorted(some.select("id", "v").collect(), key=lambda r: r["id"])]))
    k = max(1, min(cells or int(np.ceil(np.sqrt(n))), MOST_CELLS, len(sample)))
    centroids = _kmeans(sample, k, rounds)
    kinds = dict(it.dtypes)

    def file(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _slices(parts):
            c = _matrix(p.v) @ centroids.T
            yield pd.DataFrame({"id": p.id.to_numpy(), "v": p.v.to_numpy(), "cell": c.argmax(1).astype(np.int32), "angle": np.arccos(np.clip(c.max(1, initial=-1), -1, 1))})

    filed = settle(it.mapInPandas(file, f"id {kinds['id']}, v {kinds['v']}, cell int, angle double"))
    radius, rows = np.zeros(k), np.zeros(k, np.int64)
    for r in filed.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():
        radius[r["cell"]], rows[r["cell"]] = r["r"], r["n"]
    return Cells(filed.select("id", "v", "cell"), centroids, radius, rows)


def _bands(cells: Cells, block: int) -> list[list[tuple[int, int, int]]]:
    """Runs of cells with about `block` rows together, each cell as (cell, part, parts): a cell of more rows is cut into parts."""
    most = max(1, min(block, max(LEAST, int(cells.rows.sum()) // 24)))
    bands, room = [[]], most
    for cell in np.flatnonzero(cells.rows):
        n = -(-int(cells.rows[cell]) // most)
        for part in range(n):
            if bands[-1] and room < cells.rows[cell] // n:
                bands.append([])
                room = most
            bands[-1].append((int(cell), part, n))
            room -= int(cells.rows[cell]) // n
    return bands


def _route(queries: DataFrame, cells: Cells, bands: list, first: int, rest: bool) -> DataFrame:
    """(id, v, least, band, wanted): the bands that hold any of the `first` nearest cells of each query, and the places of those in the band; with rest, instead the other cells in which a row may reach the query's
    least cosine (column least; null: any row). A row of a cell is no nearer to the query than their centroid's angle less the cell's radius."""
    kinds = dict(queries.dtypes)
    centroids, radius, full = cells.centroids, cells.radius, cells.rows > 0

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _slices(parts):
            c = _matrix(p.v) @ centroids.T
            order = np.argsort(np.where(full, -c, np.inf), axis=1, kind="stable")
            take = np.zeros(c.shape, bool)
            np.put_along_axis(take, order[:, :first], True, axis=1)
            if rest:
                nearest = np.maximum(0, np.arccos(np.clip(c, -1, 1)) - radius)
                least = p.least.fillna(-2.0).to_numpy()[:, None]
                take = ~take & (np.cos(nearest) + 1e-9 >= least)
            for band, held in enumerate(bands):
                wanted = take[:, [cell for cell, _, _ in held]]
                rows = np.flatnonzero(wanted.any(1))
                if len(rows):
                    part = {"id": p.id.to_numpy()[rows], "v": p.v.to_numpy()[rows], "least": p.least.to_numpy()[rows]}
                    yield pd.DataFrame(part | {"band": np.int32(band), "wanted": [w.tobytes() for w in np.packbits(wanted[rows], axis=1)]})

    return queries.mapInPandas(route, f"id {kinds['id']}, v {kinds['v']}, least double, band int, wanted binary")


def _search(queries: DataFrame, cells: Cells, k: int, block: int, first: int, rest: bool, asked: int) -> DataFrame:
    """(query, item, cosine): the k nearest of each query (id, v, least) in each band of cells that it is sent to; below its least cosine none. Queries, of which there are `asked`, are dealt to blocks too, so that one cell
    may hold any share of either, and a query moves once for each band and not for each cell."""
    spark, kind, bands, bq = queries.sparkSession, dict(queries.dtypes)["id"], _bands(cells, block), _parts(asked, block, 4)
    where = spark.createDataFrame([(cell, part, n, band, at) for band, held in enumerate(bands) for at, (cell, part, n) in enumerate(held)], "cell int, part int, parts int, band int, at int")
    at_most = F.broadcast(where)  # as many rows as there are cells, and one for each block of rows
    counts = F.broadcast(where.select("cell", "parts").distinct())
    none = [F.lit(None).cast(t).alias(c) for c, t in (("least", "double"), ("wanted", "binary"))]
    x = _route(queries, cells, bands, first, rest).select("id", "v", "band", F.pmod(F.xxhash64("id"), F.lit(bq)).cast("int").alias("q"), "least", "wanted", F.lit(-1).alias("at"))
    placed = cells.filed.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).join(at_most, ["cell", "part"])
    y = placed.select("id", "v", "band", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("q"), *none, "at")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["at"] < 0], pdf[pdf["at"] >= 0].sort_values(["at", "id"])
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "item": [], "cosine": []})
        m, y, of, codes = _sides(a, b)
        kept = np.flatnonzero(np.isfinite(y).all(1))
        y, codes, asked, out = y[kept], codes[kept], a.id.to_numpy(), []
        some, first = np.unique(codes, return_index=True)
        names = b.id.to_numpy()[kept][first]
        place, single, least = b["at"].to_numpy()[kept], y.astype(np.float32), a.least.to_numpy(np.float64)
        wanted = np.unpackbits(np.frombuffer(b"".join(a.wanted), np.uint8).reshape(len(a), -1), axis=1).astype(bool)
        for s in range(0, len(m), TALL):
            near = Nearest(m[s : s + TALL], of[s : s + TALL], k, np.nan_to_num(least[s : s + TALL], nan=-np.inf))
            fine = np.isfinite(near.x).all(1)
            for at in np.unique(place):
                rows, (lo, hi) = np.flatnonzero(wanted[s : s + TALL, at] & fine), np.searchsorted(place, [at, at + 1])
                for t in range(lo, hi, WIDE) if len(rows) else ():
                    u = min(hi, t + WIDE)
                    near.see(rows, y[t:u], single[t:u], codes[t:u])
            r, code, c = near.found()
            real = code < np.iinfo(np.int64).max
            out.append((asked[s : s + TALL][r[real]], names[np.searchsorted(some, code[real])], c[real]))
        return _frame(out, ("query", "item", "cosine"))

    return x.unionByName(y).groupBy("band", "q").applyInPandas(best, f"query {kind}, item {kind}, cosine double")


def nearest(queries: DataFrame, cells: Cells, k: int = 5, probes: int = 8, exact: bool = True, id: str = "id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, item, cosine, pos): the k nearest items of each query, itself left out; ties by id. The probes nearest cells are searched first. exact: then every other cell that may hold a row as near as the k-th
    found, so that nothing is missed; otherwise the search ends there, and recall is what the data give."""
    q = _named(queries, id, vector)
    asked, bare = q.count(), F.lit(None).cast("double").alias("least")
    found = _search(q.select("id", "v", bare), cells, k, block, probes, False, asked)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "item"))
    if exact and probes < int((cells.rows > 0).sum()):
        found = settle(found.withColumn("pos", rank).where(F.col("pos") <= k).drop("pos"))
        have = found.groupBy("query").agg(F.min("cosine").alias("least"), F.count("*").alias("n"))
        least = q.join(have.select(F.col("query").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("least")), "id", "left")
        found = found.unionByName(_search(least, cells, k, block, probes, True, asked))
    return found.withColumn("pos", rank).where(F.col("pos") <= k)


def lsh_pairs(items: DataFrame, threshold: float = 0.93, tables: int = 8, bits: int = 14, probes: int = 2, id: str = "id", vector: str = "embedding", seed: int = 5, most: int = 4000) -> DataFrame:
    """(a, b, cosine), a < b, cosine >= threshold: pairs that share a bucket of one of several hash tables, their cosine computed exactly. None below the threshold; recall is a matter of the parameters.

    A table's key is the signs of `bits` random projections. Each row is filed under its own key, and looked up there and under the keys with one of the `probes` least certain signs turned. Rows with equal
    vectors are one class: only its representative is hashed, so a bucket holds different vectors, and copies are pairs of the class. The defaults find 0.999 of pairs at 0.93 between random vectors.
    Vectors meet in their buckets as matrices, so only links leave a bucket; one of more than `most` rows is cut."""
    it = _named(items, id, vector).where(F.expr("exists(v, x -> x <> 0)"))
    named = it.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v"))
    members = settle(named.select("id", "h", "g").join(named.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")), ["h", "g"]).select("id", "rep", "n"))
    reps = settle(it.join(members.where("id = rep").select("id"), "id", "left_semi"))
    kinds = dict(reps.dtypes)

    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plane = None
        for p in _slices(parts):
            m = _matrix(p.v)
            if plane is None:
                plane = np.random.default_rng(seed).normal(size=(m.shape[1], tables * bits))
            x = (m @ plane).reshape(len(m), tables, bits)
            own = ((x > 0) << np.arange(bits)).sum(2)
            order = np.argsort(np.abs(x), axis=2)[:, :, :probes]
            every = np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << order)], axis=2) + (np.arange(tables) << bits)[:, None]
            yield pd.DataFrame({"id": p.id.to_numpy(), "v": p.v.to_numpy(), "keys": list(every.reshape(len(m), -1).astype(np.int64))})

    hashed = settle(reps.mapInPandas(keys, f"id {kinds['id']}, v {kinds['v']}, keys array<long>"))
    each = hashed.select("id", "v", F.posexplode("keys").alias("pos", "key")).select("id", "v", "key", (F.col("pos") % (probes + 1) == 0).alias("own"))
    full = each.groupBy("key").agg(F.count_if("own").alias("f"), F.count("*").alias("l")).where(F.col("l") > most)
    hot = F.broadcast(settle(full.select("key", F.ceil(F.greatest("f", F.lit(1)) / most).cast("int").alias("nf"), F.ceil(F.col("l") / most).cast("int").alias("nl"))))  # at most one in `most` of the keys filed
    # buckets go by the run of 64, and one of many rows is cut into blocks of either side; a row moves once for each of its keys, and not for each row that it meets
    role = lambda n: F.lit(n).alias("role")
    none = F.lit(0)
    cold = each.join(hot.select("key"), "key", "left_anti").select("id", "v", "key", F.when(F.col("own"), 2).otherwise(0).alias("role"), F.shiftright("key", 6).alias("run"), none.alias("i"), none.alias("j"))
    cut, dealt = each.join(hot, "key"), lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    copied = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    filed = cut.where("own").select("id", "v", "key", role(1), (-1 - F.col("key")).alias("run"), dealt(F.col("nf")).alias("i"), copied("nl").alias("j"))
    looked = cut.select("id", "v", "key", role(0), (-1 - F.col("key")).alias("run"), copied("nf").alias("i"), dealt(F.col("nl")).alias("j"))

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        m, key, part, ids = _matrix(pdf.v), pdf.key.to_numpy(), pdf.role.to_numpy(), pdf.id.to_numpy()
        codes, single, low = pd.factorize(pdf.id, sort=True)[0], m.astype(np.float32), np.float32(threshold - _slack(m.shape[1]))
        cuts, out = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1)), [(ids[:0], ids[:0], np.zeros(0))]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            f, other = lo + np.flatnonzero(part[lo:hi] >= 1), lo + np.flatnonzero(part[lo:hi] != 1)
            for s in range(0, len(f), TALL):
                for t in range(0, len(other), WIDE):
                    r, j = np.nonzero(single[f[s : s + TALL]] @ single[other[t : t + WIDE]].T >= low)
                    r, j = f[s + r], other[t + j]
                    met = codes[r] != codes[j]
                    r, j = r[met], j[met]
                    c = _cosines(m, m, r, j)
                    r, j, c = r[c >= threshold], j[c >= threshold], c[c >= threshold]
                    turn = codes[r] > codes[j]
                    out.append((ids[np.where(turn, j, r)], ids[np.where(turn, r, j)], c))
        return _frame(out, ("a", "b", "cosine"))

    met = cold.unionByName(filed).unionByName(looked).groupBy("run", "i", "j").applyInPandas(close, f"a {kinds['id']}, b {kinds['id']}, cosine double")
    links = met.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    from vellum.operators.duplicates import Classes, expand

    return expand(Classes(members, links), {"cosine": F.lit(1.0)})

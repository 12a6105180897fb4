"""What the operators of this package share: scratch tables, Arrow text buffers, word hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that one numpy pass takes at most, unless a single document is longer.
PASS_BYTES = 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; one under the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and losing an executor
    costs no recomputation. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/vellum-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    store, where = _store(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def release(*tables: DataFrame) -> None:
    """Delete settled tables whose last reader has itself been settled."""
    for df in tables:
        store, where = _store(df.sparkSession, df._settled)
        store.delete(where, True)


_RESIDENT: dict = {}


def resident(key: object = None, make=None):
    """What a Python worker keeps from task to task: the object of the operator at work. Asking for another, or for none, drops it first, so that
    stages that follow each other in one worker do not add up."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        pa.default_memory_pool().release_unused()
        if key is not None:
            _RESIDENT[key] = make()
    return _RESIDENT.get(key)


def spare(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, end to end, and the n + 1 offsets of the rows. Null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def runs_of_rows(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes; a longer row is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    x = np.array(x, np.uint64, ndmin=1)
    t = x >> np.uint64(30)
    x ^= t
    x *= MIX_1
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= MIX_2
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(b: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, ...]:
    """Words [^\\x20\\x09-\\x0D]+ of the rows in b: 64-bit hash, row, first byte, end byte of each."""
    solid = ~_SPACE[b]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(b)]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    at = np.flatnonzero(solid)
    word = np.cumsum(first)[at] - 1
    place = at - starts[word]
    ends = np.empty(len(starts), np.int64)
    ends[word] = at + 1
    code = _BYTE_CODE[_LOWER[b[at]] if lower else b[at]]
    code *= powers(0x9E3779B97F4A7C15, int(place.max()) + 1)[place]
    h = mix(np.add.reduceat(code, np.searchsorted(at, starts)))
    return h, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def windows(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each n consecutive values of h (len(h) - n + 1 of them), whatever row they are in."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    # doubling: sums over 2^k values, combined for the bits of n
    out, have, block, size, r = None, 0, h.astype(np.uint64, copy=True), 1, np.uint64(base)
    power = r
    while True:
        if n & size:
            if out is None:
                out, have = block.copy(), size
            else:
                m = len(h) - (have + size) + 1
                out = out[:m] + block[have : have + m] * _power(r, have)
                have += size
        size *= 2
        if size > n:
            break
        block = block[: len(block) - size // 2] + block[size // 2 :] * power
        power = np.uint64((int(power) * int(power)) & 0xFFFFFFFFFFFFFFFF)
    return mix(out[: len(h) - n + 1])


def _power(r: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(r), n, 1 << 64))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of each w consecutive values of x, by their upper 36 bits, rightmost on ties (len(x) - w + 1 of them)."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    packed = np.full(-(-len(x) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    packed[: len(x)] = (x & ~low) | (low - (np.arange(len(x), dtype=np.uint64) & low))
    by_block = packed.reshape(-1, w)
    left = np.minimum.accumulate(by_block, 1).ravel()
    right = np.minimum.accumulate(by_block[:, ::-1], 1)[:, ::-1].ravel()
    code = low - (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & low)
    at = np.arange(n, dtype=np.uint64)
    return (at + ((code - at) & low)).astype(np.int64)


def sample_by_hash(df: DataFrame, column: str, rows: int, seed: int = 0) -> DataFrame:
    """About `rows` rows of df, all where it has no more: those whose hash of the column is below a bound that their number gives."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * (rows / n)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable over edges. Nodes without an edge are not listed.

    Each round takes the smallest label among the neighbours (a partial aggregate, so a hub's rows are never
    together), hands it to the label held before (the old root, which learns it a round later), and then jumps to the
    label's own label. Labels only fall; rounds go on until none does, whatever their number.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = settle(both.union(both.select(F.col("v"), F.col("u"))).distinct())
    label = settle(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")))
    met = None
    while True:
        seen = both.join(label.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").select("u", "r")
        if met is not None:
            seen = seen.union(met.where("r < old").select("old", "r"))
        near = seen.groupBy("u").agg(F.min("r").alias("r"))
        took = label.join(near, label.node == near.u).select("node", F.least("root", "r").alias("mid"), F.col("root").alias("old"), "r")
        up = label.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        met = settle(took.join(up, "mid").select("node", F.least("mid", "top").alias("root"), "old", "r"))
        moved = met.where("root <> old").limit(1).count()
        label = met.select("node", "root")
        if not moved:
            return label

"""Document fingerprints by winnowing: the smallest k-gram hash of every window, rightmost on ties, with positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, parts, settle, spare, window_min, windows

#: Two texts that share a stretch of GRAM + WINDOW - 1 code points share a selected hash.
GRAM, WINDOW = 12, 52


def gram_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """Rolling 64-bit hash of every gram of a text; a shorter text is one gram."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return windows(mix(c.astype(np.uint64) + np.uint64(1)), min(gram, len(c)))


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected 32-bit hashes of a text and where their grams start, in order of position.

    A text shorter than a gram is one gram; one with fewer grams than a window has one window. Empty: nothing."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    h = gram_hashes(text, gram)
    at = window_min(h, min(window, len(h)))
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return (h[at] >> np.uint64(32)).astype(np.uint32), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the shared distinct hashes over the sum of distinct hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) + len(b):
        return 1.0
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def to_string(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add hashes (array<long>) and positions (array<int>) of each whole text; null is empty. Equal texts get equal ones."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            found = [winnow(t or "") for t in s]
            yield pd.DataFrame({"hashes": [h.astype(np.int64) for h, _ in found], "positions": [p.astype(np.int32) for _, p in found]})

    udf = F.pandas_udf(run, "hashes array<long>, positions array<int>")
    kept = docs.drop("hashes", "positions")
    found = spare(kept, "found")
    return kept.withColumn(found, udf(F.col(text))).select("*", f"{found}.*").drop(found)


REPORT = "doc_id long, n_chars long, edited_text string, hashes binary, edited_hashes binary, near_edited double, near_next double, positions array<int>, edited_positions array<int>"


def compare_with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited form and of the next document; columns: see REPORT.

    The edited form has the last floor(n/2) code points replaced by the first as many of the next document, in
    ascending id (after the last: the first). Null texts are empty; rows without an id are left out. Of rows with the
    same id each is compared, and the least of their texts is the next document's. Hashes are big-endian 32-bit numbers end to end; positions
    tell where their grams start, in code points.

    Texts move once: to ranges of ids, whose bounds are as many numbers as there are partitions. The first document of a
    range goes to the range before it as well, so each range is read in order with the next document at hand.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    n = parts(spark)
    ids = own.select("doc_id")
    bounds = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    place = F.expr("0") if not bounds else F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id")))
    heads = settle(ids.groupBy(place.alias("range")).agg(F.min("doc_id").alias("head")))
    ahead = heads.selectExpr("head", "coalesce(lag(range) over (order by range), max(range) over ()) as earlier")  # a row for each range
    marked = own.withColumn("range", place).join(F.broadcast(ahead), F.col("doc_id") == F.col("head"), "left")
    both = F.when(F.col("earlier").isNull(), F.array(F.struct("range", F.lit(False).alias("ahead")))).otherwise(F.array(F.struct("range", F.lit(False).alias("ahead")), F.struct(F.col("earlier").alias("range"), F.lit(True).alias("ahead"))))
    dealt = marked.select("doc_id", "text", F.explode(both).alias("to")).select("to.range", "to.ahead", "doc_id", "text")
    ordered = dealt.repartition(n, "range").sortWithinPartitions("range", "ahead", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = [c.split()[0] for c in REPORT.split(", ")]
        held: list[str] = []
        at: tuple | None = None  # range and id of the texts held
        kept = None  # fingerprint of the document that was next a moment ago
        out: list[tuple] = []

        def close(following: str):
            nonlocal kept
            after = winnow(following)
            for k, t in enumerate(held):
                half = len(t) // 2
                edited = t[: len(t) - half] + following[:half]
                h, where = kept if k == 0 and kept is not None else winnow(t)
                e, there = winnow(edited)
                out.append((at[1], len(t), edited, h.astype(">u4").tobytes(), e.astype(">u4").tobytes(), likeness(h, e), likeness(h, after[0]), where.astype(np.int32), there.astype(np.int32)))
            kept = after

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for lo in range(0, batch.num_rows, 256):
                for where, ahead, name, t in zip(*(c.slice(lo, 256).to_pylist() for c in columns)):
                    if at is not None and at[0] == where and (ahead or at[1] != name):
                        if held:
                            close(t)
                        held = []
                    if not ahead:
                        if at is None or at[0] != where:
                            kept = None
                        at = (where, name)
                        held.append(t)
                if sum(len(r[2]) for r in out) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return ordered.mapInArrow(run, REPORT)

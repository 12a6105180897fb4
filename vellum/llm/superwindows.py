"""Repeated windows of fixed length, found through super-windows.

Every window of W units holds a gram of G units with the smallest hash: its anchor. Consecutive windows with the same
anchor are one super-window. Equal windows have equal anchors at equal places, so windows need comparing only between super-windows of
one anchor, and an anchor that occurs once rules its windows out.

Rows of a table are named by a key of their own: their id where ids are unique, else a hash of id and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import _BYTE_CODE, mix, powers, resident, runs_of_rows, text_bytes, window_min, windows, words

OCCURRENCE = "first long, anchor long, seg long, row long, start int, n_windows int, lead int"
SEG = ["anchor", "seg"]
_BASE = 0xA0761D6478BD642F
#: Row keys that are broadcast at most (32 MB).
BROADCAST_ROWS = 4_000_000


def as_words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    return words(b, offsets)


def as_bytes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    at = np.arange(len(b))
    return _BYTE_CODE[b], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), at, at + 1


def with_rows(docs: DataFrame) -> DataFrame:
    """docs with a key for each row. Rows that repeat an id with its text share theirs, as they share what they lose."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    return docs.withColumn("row", F.col("doc_id") if odd.isEmpty() else F.xxhash64("doc_id", "text"))


def prefix_sums(code: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * powers(_BASE, len(code)), dtype=np.uint64)])


def stretch_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the units a to b, wherever they stand. It is used beside the anchor's, so 128 bits tell stretches apart."""
    back = powers(pow(_BASE, -1, 1 << 64), int(a.max(initial=0)) + 1)
    return mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)).view(np.int64)


def super_windows(code: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First unit, number of windows, anchor hash and anchor's place of each super-window."""
    none = np.empty(0, np.int64)
    if len(code) < window:
        return none, none, none, none
    g = windows(code, gram)
    at = window_min(g, window - gram + 1)
    inside = row[: len(at)] == row[window - 1 : window - 1 + len(at)]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (at[1:] != at[:-1]) | (row[1 : len(at)] != row[: len(at) - 1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return none, none, none, none
    n = np.add.reduceat(inside.astype(np.int64), starts)
    return starts, n, g[at[starts]].view(np.int64), at[starts]


def doubled(sums: np.ndarray, starts: np.ndarray, n: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-windows cut in two where the anchor's double changes sides: (which, first window, windows) and the hash of the double.

    The double is the anchor with the gram after it, where the window holds that, else with the gram before it; so equal windows have
    equal doubles too."""
    border = at - (window - 2 * gram)  # from here on windows hold the gram after the anchor
    ends = starts + n
    left, right = np.flatnonzero(starts < border), np.flatnonzero(ends > border)
    which = np.concatenate([left, right])
    begin = np.concatenate([starts[left], np.maximum(starts[right], border[right])])
    count = np.concatenate([np.minimum(ends[left], border[left]), ends[right]]) - begin
    a = np.concatenate([at[left] - gram, at[right]])
    side = np.repeat(np.array([0x2545F4914F6CDD1D, 0], np.uint64), [len(left), len(right)])
    return which, np.stack([begin, count]), mix(stretch_hash(sums, a, a + 2 * gram).view(np.uint64) ^ side).view(np.int64)


def occurrences(docs: DataFrame, units: Callable, window: int, gram: int, double: bool = False) -> DataFrame:
    """Every super-window of docs (row, text), with a hash of all its units; start counts units of its text, lead is the anchor's place from there.

    double: each is cut where the anchor's double changes sides; anchor is then the hash of the double and first that of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            b, offsets = text_bytes(batch.column(1))
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in runs_of_rows(offsets):
                o = offsets[lo : hi + 1] - offsets[lo]
                code, row, _, _ = units(b[offsets[lo] : offsets[hi]], o)
                starts, n, anchor, at = super_windows(code, row, window, gram)
                if not len(starts):
                    continue
                sums, first = prefix_sums(code), anchor
                if double:
                    which, (starts, n), anchor = doubled(sums, starts, n, at, window, gram)
                    first, at = first[which], at[which]
                x = stretch_hash(sums, starts, starts + n + window - 1)
                begin = np.searchsorted(row, row[starts])
                columns = [first, anchor, x, rows[lo + row[starts]], (starts - begin).astype(np.int32), n.astype(np.int32), (at - starts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in OCCURRENCE.split(", ")])

    return docs.select("row", "text").mapInArrow(run, OCCURRENCE)


def at_documents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (row, text) with the list `wanted` of the rows of wanted that name them; documents without are left out, before their texts
    move where they are told by few enough keys to broadcast. A list is as long as its document has super-windows."""
    names = wanted.select("row").distinct()
    if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(names), "row", "left_semi")
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != "row"])).alias("wanted"))
    return docs.select("row", "text").hint("merge").join(lists, "row")


def wanted_stretches(batch: pa.RecordBatch, units: Callable, fields: int) -> Iterator[tuple]:
    """For each pass over the texts of a batch (text, wanted): the sums of its units, and of each wanted struct the first unit of its text and its fields."""
    b, offsets = text_bytes(batch.column(0))
    flat, lens = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    columns = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(fields)]
    for lo, hi in runs_of_rows(offsets):
        code, row, _, _ = units(b[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        begin = np.searchsorted(row, np.arange(hi - lo))
        k = slice(int(ends[lo] - lens[lo]), int(ends[hi - 1]))
        yield prefix_sums(code), np.repeat(begin, lens[lo:hi]), [c[k] for c in columns]


def single_windows(joined: DataFrame, units: Callable, window: int) -> DataFrame:
    """Each window of the wanted super-windows (anchor, seg, start, n_windows, weight): its place there and its hash."""
    schema = "anchor long, seg long, weight long, place int, hash long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums, base, (anchor, seg, start, n, weight) in wanted_stretches(batch, units, 5):
                for part in np.array_split(np.arange(len(base)), max(1, len(base) // 2000)):
                    m = n[part].astype(np.int64)
                    place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    a = np.repeat(base[part] + start[part], m) + place
                    x = stretch_hash(sums, a, a + window)
                    columns = [np.repeat(anchor[part], m), np.repeat(seg[part], m), np.repeat(weight[part], m), place.astype(np.int32), x]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in schema.split(", ")])

    return joined.select("text", "wanted").mapInArrow(run, schema)


ADDED = ("n_units", "n_removed", "n_spans", "kept")


def remove_spans(docs: DataFrame, spans: DataFrame, units: Callable, joiner: bytes, same_if_whole: bool = False) -> DataFrame:
    """docs (row, text and others) without the units covered by spans (row, start, end): n_units, n_removed, n_spans (maximal removed runs) and kept
    in place of row and text. Other columns stay; those named like one added are replaced.

    Kept units stand end to end with joiner between them; with same_if_whole a text that loses nothing stays as it is. Null texts are empty.
    A document's list of spans is as long as it has super-windows at most."""
    carry = [c for c in docs.columns if c not in ("row", "text", *ADDED)]
    own = docs.select(F.col("row").alias("_row"), F.col("text").alias("_text"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)))
    lists = spans.groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_s"))
    joined = own.hint("merge").join(lists, "_row", "left").select("_text", "_s", *(f"_c{i}" for i in range(len(carry))))
    schema = StructType([*joined.schema.fields[2:], *(StructField(c, LongType()) for c in ADDED[:3]), StructField(ADDED[3], BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offsets = text_bytes(batch.column(0))
            lens = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten()
            s, e = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            ends = np.cumsum(lens)
            for lo, hi in runs_of_rows(offsets):
                part, o = b[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                _, row, first, last = units(part, o)
                begin = np.searchsorted(row, np.arange(hi - lo + 1))
                k = np.arange(ends[lo] - lens[lo], ends[hi - 1])
                owner = np.repeat(np.arange(hi - lo), lens[lo:hi])
                depth = np.zeros(len(row) + 1, np.int64)
                np.add.at(depth, begin[owner] + s[k], 1)
                np.add.at(depth, begin[owner] + e[k], -1)
                gone = np.cumsum(depth)[:-1] > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
                cum = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens)]
                removed, runs = (c[begin[1:]] - c[begin[:-1]] for c in cum)
                kept = []
                data = part.tobytes()
                for i in range(hi - lo):
                    a, z = int(begin[i]), int(begin[i + 1])
                    if not removed[i] and (same_if_whole or joiner == b""):
                        kept.append(data[o[i] : o[i + 1]])
                    elif joiner == b"":
                        kept.append(part[o[i] : o[i + 1]][~gone[a:z]].tobytes())
                    else:
                        at = np.flatnonzero(~gone[a:z]) + a
                        kept.append(joiner.join([data[p:q] for p, q in zip(first[at].tolist(), last[at].tolist())]))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[2:]), pa.array(np.diff(begin)), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())], schema.names)

    return joined.mapInArrow(run, schema).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), *ADDED)

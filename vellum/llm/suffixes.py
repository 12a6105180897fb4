"""Suffix-array dedup with a run-length index: run-compressed Burrows-Wheeler transforms with samples at run ends, over which
matching statistics are streamed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, release, settle
from .superwindows import SEG, as_bytes, at_documents, occurrences, remove_spans, stretch_hash, wanted_stretches, with_rows

#: Bytes that one index covers, unless one anchor has more, and forms that an anchor may have before it is split.
INDEX_BYTES, INDEX_FORMS = 1_500_000, 3000
#: Windows to which the forms of such an anchor are cut; of the last size all windows of a group are equal, so nothing is left to split.
SPLITS = (16, 1)


def suffix_order(code: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes of code in order. code: strings with a 0 after each, which is less the earlier it stands; left: units before the next 0."""
    n, size = len(code), 7
    padded = np.concatenate([code, np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(size):
        key = key << 9 | np.where(left >= j, padded[j : j + n], 0)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (left[order[1:]] < size)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        rows = np.flatnonzero(~alone)  # of groups that are still to be told apart
        if not len(rows):
            return order
        sub = order[rows]
        key = group[rows] * n + rank[sub + size]
        o = np.argsort(key, kind="stable")
        order[rows] = sub[o]
        new[rows[1:]] = np.diff(key[o]) != 0
        group[rows] = np.maximum.accumulate(np.where(new[rows], rows, 0))
        rank[order[rows]] = group[rows]
        size *= 2


class RunIndex:
    """Run-length index of a set of byte strings. Kept are, for each run of the Burrows-Wheeler transform, its unit, its first row, where
    that row goes by one step back in the text, and samples: the places of its first and last suffix, as lengths of what they share
    with the nearest suffix above or below that a step back from another run leads to. No match crosses a string's end."""

    def __init__(self, strings: list[bytes]):
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        self.lens = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(self.lens + 1) - 1
        n = self.n = len(text)
        left = np.repeat(self.ends, self.lens + 1) - np.arange(n)
        code = text.astype(np.int64) + 1
        code[self.ends] = 0
        order = suffix_order(code, left)
        before = code[order - 1]
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if n else np.empty(0, np.int64)
        ends = np.append(starts[1:], n)
        self.head, self.start = before[starts], np.append(starts, n)
        same = np.argsort(self.head, kind="stable")  # runs of one unit stand together, in order
        size = (ends - starts)[same]
        self.goal = np.empty(len(starts), np.int64)
        self.goal[same] = np.cumsum(size) - size
        self.goal_run = np.searchsorted(starts, self.goal, "right") - 1
        # samples: one step back from a run's first row leads beside the step from the last row of the run of its unit before it
        first, last = order[starts], order[ends - 1]
        words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
        pair = np.flatnonzero(self.head[same[1:]] == self.head[same[:-1]])
        upper, lower = same[pair], same[pair + 1]
        shared = 1 + _common(words, left, last[upper], first[lower])
        self.above, self.below = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        self.above[lower], self.below[upper] = shared, shared

    def statistics(self) -> list[np.ndarray]:
        """For each string, at each place the length of the longest match that starts anywhere else. All strings are streamed at
        once, from their ends: within a run a match grows by the unit before it; at a run's end the sample tells its length."""
        out = np.zeros(self.n, np.int64)
        begin = self.ends - self.lens
        live = np.flatnonzero(self.lens > 0)
        row, at = live.copy(), self.ends[live]  # a string's end is the row of its number
        run = np.searchsorted(self.start, row, "right") - 1
        up, down = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        while len(live):
            up = np.where(row == self.start[run], self.above[run], up + 1)
            down = np.where(row == self.start[run + 1] - 1, self.below[run], down + 1)
            row = self.goal[run] + row - self.start[run]
            run = self.goal_run[run]
            far = np.flatnonzero(row >= self.start[run + 1])
            for _ in range(4):
                if not len(far):
                    break
                run[far] += 1
                far = far[row[far] >= self.start[run[far] + 1]]
            if len(far):
                run[far] = np.searchsorted(self.start, row[far], "right") - 1
            at = at - 1
            out[at] = np.maximum(up, down)
            go = at > begin[live]
            if not go.all():
                live, row, run, at, up, down = (x[go] for x in (live, row, run, at, up, down))
        return [out[e - n : e] for e, n in zip(self.ends.tolist(), self.lens.tolist())]


def _common(words: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of the suffixes at a and b."""
    most = np.minimum(left[a], left[b])
    out = most.copy()
    live, k = np.flatnonzero(most > 0), 0
    while len(live):
        x = np.ascontiguousarray(words[a[live] + k]).view("<u8").ravel() ^ np.ascontiguousarray(words[b[live] + k]).view("<u8").ravel()
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        at = live[differ]
        out[at] = np.minimum(out[at], k + (np.log2(low.astype(np.float64)) // 8).astype(np.int64))
        k += 8
        live = live[~differ]
        live = live[most[live] > k]
    return out


def matching_places(strings: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each string the ranges of starts whose window also starts anywhere else among the strings."""
    out = []
    for s in RunIndex(strings).statistics() if strings else []:
        x = np.flatnonzero(np.diff(np.concatenate([[0], (s >= window).astype(np.int8), [0]])))
        out.append(list(zip(x[::2].tolist(), x[1::2].tolist())))
    return out


def _batch(rows: list[tuple], schema: str, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], re.findall(r"(?:^|, )(\w+) ", re.sub("<.*>", "", schema)))


def _cut_out(joined: DataFrame, window: int) -> DataFrame:
    """The bytes of the wanted super-windows (anchor, seg, start, n_windows, ...)."""
    schema = "anchor long, seg long, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for text, wanted in zip(batch.column(0), batch.column(1)):
                data = (text.as_py() or "").encode()
                for w in wanted.as_py():
                    rows.append((w["anchor"], w["seg"], data[w["start"] : w["start"] + w["n_windows"] + window - 1]))
                    held += w["n_windows"] + window
                if held > 4_000_000:
                    yield _batch(rows, schema, (pa.int64(), pa.int64(), pa.binary()))
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema, (pa.int64(), pa.int64(), pa.binary()))

    return joined.select("text", "wanted").mapInArrow(run, schema)


def _indexed(bodies: DataFrame, window: int) -> DataFrame:
    """Ranges of starts that match elsewhere, for super-windows sorted by anchor: whole anchors go into one index until it is full."""
    schema = "anchor long, seg long, places array<struct<a int, b int>>"
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))

    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = matching_places([r[2] for r in rows], window)
        out = [(*r[:2], [{"a": a, "b": b} for a, b in p]) for r, p in zip(rows, found) if p]
        if out:
            yield _batch(out, schema, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held > INDEX_BYTES and rows[-1][0] != r[0]:
                    yield from answer(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[2])
        if rows:
            yield from answer(rows)

    return bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, schema)


CUT = "anchor long, seg long, shift int, piece_anchor long, piece_seg long, row long, start int, n_windows int, lead int, copies long"


def _split(joined: DataFrame, window: int, span: int) -> DataFrame:
    """Wanted forms (anchor, seg, start, n_windows, lead, copies) cut where the anchor's distance to the window's start passes a multiple of span.

    The windows of a piece all hold the window - span + 1 bytes from its greatest distance on; a hash of those is the piece's anchor. Equal windows
    have their anchors at equal distances, so they are in pieces of one anchor again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums, base, (anchor, seg, start, n, lead, copies, row) in wanted_stretches(batch, as_bytes, 7):
                base, n, lead = base + start, n.astype(np.int64), lead.astype(np.int64)
                top, low = lead // span, (lead - n + 1) // span
                of = np.repeat(np.arange(len(n)), top - low + 1)
                k = top[of] - (np.arange(len(of)) - np.repeat(np.cumsum(top - low + 1) - (top - low + 1), top - low + 1))
                shift = np.maximum(0, lead[of] - ((k + 1) * span - 1))
                count = np.minimum(n[of] - 1, lead[of] - k * span) - shift + 1
                core = (base + lead)[of] - k * span
                key = mix(stretch_hash(sums, core, core + window - span + 1).view(np.uint64) ^ mix(anchor[of].view(np.uint64) + k.astype(np.uint64))).view(np.int64)
                x = stretch_hash(sums, base[of] + shift, base[of] + shift + count + window - 1)
                columns = [anchor[of], seg[of], shift.astype(np.int32), key, x, row[of], (start[of] + shift).astype(np.int32), count.astype(np.int32), (lead[of] - shift).astype(np.int32), copies[of]]
                for a in range(0, len(of), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in columns], [c.split()[0] for c in CUT.split(", ")])

    return joined.select("text", "wanted").mapInArrow(run, CUT)


FORM = ("anchor", "seg", "row", "start", "n_windows", "lead", "copies")


def _marked(docs: DataFrame, forms: DataFrame, window: int, splits: tuple[int, ...], made: list[DataFrame]) -> DataFrame:
    """(anchor, seg, places): ranges of starts whose window starts in another form of the anchor too. forms: settled, FORM. made: settled tables."""
    several = settle(forms.groupBy("anchor").agg(F.count("*").alias("forms")).where("forms > 1"))
    made.append(several)
    ours = forms.join(several, "anchor")
    hot = F.col("forms") > INDEX_FORMS
    plain = ours.where(~hot) if splits else ours
    found = _indexed(_cut_out(at_documents(docs, plain.select("row", *SEG, "start", "n_windows")), window), window)
    if not splits or several.where(hot).isEmpty():
        return found
    wanted = ours.where(hot).select("row", *SEG, "start", "n_windows", "lead", "copies", F.col("row").alias("whose"))
    cut = settle(_split(at_documents(docs, wanted), window, splits[0]))
    piece = settle(cut.groupBy("piece_anchor", "piece_seg").agg(F.min(F.struct("row", "start", "n_windows", "lead")).alias("one"), F.sum("copies").alias("copies")).select(F.col("piece_anchor").alias("anchor"), F.col("piece_seg").alias("seg"), "one.*", "copies"))
    made += [cut, piece]
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n_windows").alias("b")))
    marks = settle(piece.where("copies > 1").select(*SEG, whole.alias("places")).unionByName(_marked(docs, piece, window, splits[1:], made)))
    made.append(marks)
    back = cut.join(marks.select(F.col("anchor").alias("piece_anchor"), F.col("seg").alias("piece_seg"), "places"), ["piece_anchor", "piece_seg"])
    moved = back.select(*SEG, F.explode(F.transform("places", lambda p: F.struct((p.a + F.col("shift")).alias("a"), (p.b + F.col("shift")).alias("b")))).alias("p"))
    return found.unionByName(moved.groupBy(*SEG).agg(F.collect_set("p").alias("places")))


def repeated_spans(docs: DataFrame, window: int = 200, gram: int = 32) -> DataFrame:
    """(row, start, end) in bytes of docs (doc_id, text, row): strings of `window` bytes that also start anywhere else,
    in the same document or another. Spans may overlap.

    Super-windows route what can be equal to one place: those of one anchor. Equal ones are one form, kept once with their number; a form with
    copies repeats all its windows. The different forms of an anchor go, whole anchors together, into run-length indexes of about INDEX_BYTES, and
    matching statistics of at least `window` mark their windows. A hot anchor, with more than INDEX_FORMS forms, is split first: its forms are cut to
    pieces of few windows, named by what all of these hold, and equal pieces are one again; the pieces go the same way (see SPLITS).
    """
    found = settle(occurrences(docs, as_bytes, window, gram).drop("first"))
    shared = settle(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    left = settle(found.join(shared, "anchor"))
    release(found, shared)
    segs = settle(left.groupBy(*SEG).agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "n_windows", "lead")).alias("one")).select(*SEG, "one.*", "copies"))
    made: list[DataFrame] = []
    some = settle(_marked(docs, segs, window, SPLITS, made))
    marked = settle(segs.select(*SEG, "copies").join(some, SEG, "left").where("copies > 1 or places is not null"))
    release(some, *made)
    to_end = F.col("start") + F.col("n_windows") + window - 1
    each = F.transform("places", lambda p: F.struct((F.col("start") + p.a).alias("start"), (F.col("start") + p.b + window - 1).alias("end")))
    spans = left.drop("lead").join(marked, SEG).select("row", F.explode(F.when(F.col("copies") > 1, F.array(F.struct(F.col("start"), to_end.alias("end")))).otherwise(each)).alias("span"))
    spans = settle(spans.select("row", "span.start", "span.end"))
    release(left, segs, marked)
    return spans


def dedup_suffixes(docs: DataFrame, window: int = 200, gram: int = 32, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs: doc_id, n_units (bytes), n_removed, n_spans (maximal removed runs) and kept (binary: the bytes left, end to end).

    Null texts are empty. Texts shorter than the window lose nothing. Rows with one id, or without one, are documents of their own."""
    own = with_rows(docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    return remove_spans(own, repeated_spans(own, window, gram), as_bytes, b"")
